"""Paired statistics of two systems over the same cases, corrections for many tests, and decision rules. Inputs are
small aggregates (one row per cluster, method or test); closed forms run as columns, enumerations over a bounded range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Clusters up to which sign flips are enumerated (2 ** 16 cases); more are drawn.
EXACT_CLUSTERS = 16


def mcnemar(gain: Column, loss: Column) -> Column:
    """Exact two-sided p of a discordant split, by a sum of binomial terms in logarithms; 1 without discordance."""
    n, k = gain + loss, F.least(gain, loss)
    logf = lambda m: F.aggregate(F.when(m >= 1, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    terms = F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: F.exp(logf(n) - logf(i) - logf(n - i) - n * F.lit(math.log(2))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def sign_flip_exact(clusters: DataFrame, net: str = "net") -> DataFrame:
    """Two-sided p over all sign flips of the non-zero cluster nets; for at most ``EXACT_CLUSTERS`` clusters, else refused."""
    nets = [r[0] for r in clusters.where(F.col(net) != 0).orderBy(net).limit(EXACT_CLUSTERS + 1).select(net).collect()]
    if len(nets) > EXACT_CLUSTERS:
        raise ValueError("too many clusters to enumerate; use sign_flip_drawn")
    flips = clusters.sparkSession.range(1 << len(nets))
    total = F.lit(0)
    for i, v in enumerate(nets):
        total = total + F.when(F.shiftright("id", i).bitwiseAND(1) == 1, int(v)).otherwise(-int(v))
    return flips.agg((F.count_if(F.abs(total) >= abs(int(sum(nets)))) / F.count("*")).alias("p"), F.lit(len(nets)).alias("clusters"))


def sign_flip_drawn(clusters: DataFrame, key: str, net: str = "net", draws: int = 2000, seed: int = 42) -> DataFrame:
    """The same by signs drawn from hashes of (seed, draw, cluster); one aggregate over draws x clusters."""
    c = clusters.where(F.col(net) != 0).select(key, F.col(net).alias("n"))
    signs = c.crossJoin(F.broadcast(clusters.sparkSession.range(draws).withColumnRenamed("id", "draw"))).select("draw", F.when(F.xxhash64(F.lit(seed), "draw", key).bitwiseAND(1) == 1, F.col("n")).otherwise(-F.col("n")).alias("v"), "n")
    sums = signs.groupBy("draw").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return sums.agg(((F.count_if(F.abs("v") >= F.abs("n")) + 1) / (F.count("*") + 1)).alias("p"))


def bootstrap(clusters: DataFrame, key: str, net: str, cases: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean net per case, clusters drawn with weights from a Poisson of mean 1."""
    u = (F.xxhash64(F.lit(seed), "draw", key).bitwiseAND((1 << 53) - 1)) / F.lit(float(1 << 53))
    weight, cumulative, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 9):
        cumulative += p
        weight = weight + F.when(u >= cumulative, 1).otherwise(0)
        p /= k
    x = clusters.crossJoin(F.broadcast(clusters.sparkSession.range(draws).withColumnRenamed("id", "draw"))).withColumn("w", weight)
    means = x.groupBy("draw").agg((F.sum(F.col("w") * F.col(net)) / F.greatest(F.sum(F.col("w") * F.col(cases)), F.lit(1))).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def design_effect(clusters: DataFrame, hits: str, cases: str) -> DataFrame:
    """Variance of the hit rate between clusters against that of independent cases."""
    t = clusters.agg(F.sum(hits).alias("h"), F.sum(cases).alias("n"), F.count("*").alias("k"), F.sum(F.col(hits) * F.col(hits)).alias("hh"), F.sum(F.col(hits) * F.col(cases)).alias("hn"), F.sum(F.col(cases) * F.col(cases)).alias("nn"))
    p = F.col("h") / F.col("n")
    between = (F.col("hh") - 2 * p * F.col("hn") + p * p * F.col("nn")) * F.col("k") / (F.col("k") - 1)
    return t.select(F.when((p > 0) & (p < 1) & (F.col("k") > 1), between / (F.col("n") * p * (1 - p))).alias("effect"), F.col("k").alias("clusters"))


def holm(tests: DataFrame, name: str, p: str, *family: str) -> DataFrame:
    """Holm's step-down adjusted p; ties in order of the name."""
    w = Window.partitionBy(*family).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*family))
    stepped = tests.withColumn("_s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return stepped.withColumn("adjusted", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = hits / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half


def best_setting(results: DataFrame, setting: str, score: str, larger_wins: bool = True) -> DataFrame:
    """The setting of the best score; ties go to the larger (or smaller) setting."""
    key = F.struct(score, F.col(setting) if larger_wins else -F.col(setting))
    return results.agg(F.max_by(setting, key).alias(setting), F.max(score).alias(score))


def effective(contrasts: DataFrame, name: str, seeds: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """Contrasts (``name``, gain, loss, difference) with ``p``, ``adjusted``, ``spread``, ``beyond``, ``significant`` and ``effective``.

    ``seeds`` has a value for each name and repeated run; a difference counts if it is larger than their range and Holm's
    adjusted p of the discordant cases is under ``alpha``. A name without runs has no range and is not effective.
    """
    ranges = seeds.groupBy(name).agg((F.max(value) - F.min(value)).alias("spread"))
    tested = holm(contrasts.withColumn("p", mcnemar(F.col("gain"), F.col("loss"))), name, "p").join(ranges, name, "left")
    beyond = F.coalesce(F.abs("difference") > F.col("spread"), F.lit(False))
    return tested.withColumns({"beyond": beyond, "significant": F.col("adjusted") < alpha}).withColumn("effective", F.col("beyond") & F.col("significant"))


def decide(contrasts: DataFrame, name: str, winner: str, first: str, default: str) -> DataFrame:
    """``(choice, basis)`` from effective contrasts (``name``, ``effective``, ``winner``): none effective gives ``default``; agreeing ones
    decide; where they disagree the contrast named ``first`` does, or the default if that is not effective."""
    votes = contrasts.where(F.col("effective") & F.col(winner).isNotNull()).agg(F.collect_set(winner).alias("w"), F.max(F.when(F.col(name) == first, F.col(winner))).alias("f"))  # one vote for each contrast
    n = F.size("w")
    return votes.select(F.when(n == 0, default).when(n == 1, F.col("w")[0]).otherwise(F.coalesce("f", F.lit(default))).alias("choice"), F.when(n == 0, "none effective").when(n == 1, "agreement").when(F.col("f").isNotNull(), "first").otherwise("default").alias("basis"))


def rescored(features: DataFrame, methods: dict[str, list[tuple]]) -> DataFrame:
    """The first choice of each item under each method and setting: ``(method, setting, weight, item, source, exact)``.

    ``features``: (item, pos, c, f, n, z, correct, source), the contextual score, the score without context, the length and
    the engine's score. Methods: ``baseline`` c; ``pmi`` c - p f; ``length`` c + p n; ``engine`` c + p z; ``combined`` c - p f + q z;
    ``gated-engine`` c + p z where the first two of c are closer than q. Ties keep the pool's order. Settings are a small list.
    """
    spark = features.sparkSession
    rows = [(m, i, float(sum(abs(x) for x in p)), *(tuple(map(float, p)) + (0.0, 0.0))[:2]) for m, ps in methods.items() for i, p in enumerate(ps)]
    settings = spark.createDataFrame(rows, "method string, setting int, weight double, p double, q double")
    r = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("c"), "pos"))
    two = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 2, F.struct("r", "c")))), lambda x: x["c"])
    gap = features.withColumn("r", r).groupBy("item").agg(two.alias("t")).select("item", F.when(F.size("t") == 2, F.col("t")[0] - F.col("t")[1]).alias("gap"))
    c, f, n, z, p, q = (F.col(x) for x in "cfnzpq")
    gated = F.when(F.col("gap").isNull() | (F.col("gap") >= q), c).otherwise(c + p * z)
    value = F.when(F.col("method") == "pmi", c - p * f).when(F.col("method") == "length", c + p * n).when(F.col("method") == "engine", c + p * z).when(F.col("method") == "combined", c - p * f + q * z).when(F.col("method") == "gated-engine", gated).otherwise(c)
    each = features.join(gap, "item").crossJoin(F.broadcast(settings)).withColumn("value", value)
    best = F.min_by(F.struct("correct", "source"), F.struct(-F.col("value"), F.col("pos")))
    return each.groupBy("method", "setting", "weight", "item").agg(best.alias("b")).select("method", "setting", "weight", "item", "b.source", F.col("b.correct").alias("exact"))


def best_of_methods(choices: DataFrame, method: str, setting: str) -> DataFrame:
    """``(method, setting, exact)``: of each method the setting with most right first choices; ties to the smaller weights, then the first."""
    sums = choices.groupBy(method, setting, "weight").agg(F.count_if("exact").alias("exact"))
    key = F.struct("exact", -F.col("weight"), -F.col(setting))
    return sums.groupBy(method).agg(F.max_by(setting, key).alias(setting), F.max("exact").alias("exact"))


def cross_validated(choices: DataFrame, fold: str) -> DataFrame:
    """``(method, fold, setting, cases, exact)``: the setting chosen on all other folds, judged on this one."""
    sums = choices.groupBy("method", "setting", "weight", fold).agg(F.count_if("exact").alias("x"), F.count("*").alias("n"))  # one row for each setting and fold
    whole = sums.groupBy("method", "setting", "weight").agg(F.sum("x").alias("all"))
    rest = sums.join(whole, ["method", "setting", "weight"]).withColumn("elsewhere", F.col("all") - F.col("x"))
    key = F.struct("elsewhere", -F.col("weight"), -F.col("setting"))
    return rest.groupBy("method", fold).agg(F.max_by(F.struct("setting", "n", "x"), key).alias("b")).select("method", fold, "b.setting", F.col("b.n").alias("cases"), F.col("b.x").alias("exact"))
