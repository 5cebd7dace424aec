"""Operators on tables of records that a corpus build and its reports need: provenance, splits and pools by hash, decisions
of reviewers, and counters. Each takes tables and column names, so that it fits any schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import hash_fraction
from corpusmill.operators.annotations import require
from corpusmill.operators.dedup import global_rank


def by_bounds(u: Column, bounds: list[tuple[float, object]], rest: object = None) -> Column:
    """The value of the first bound that lies above ``u``; bounds grow."""
    out = None
    for bound, value in bounds:
        out = F.when(u < bound, F.lit(value)) if out is None else out.when(u < bound, F.lit(value))
    return out.otherwise(F.lit(rest)) if out is not None else F.lit(rest)


def modulo_split(key: Column, parts: int, bounds: list[tuple[int, str]], rest: str) -> Column:
    """A split by the leading 60 bits of the key's sha256 modulo ``parts``."""
    h = F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("bigint"), F.lit(parts))
    return by_bounds(h, bounds, rest)


def hash_tier(key: Column, salt: str, bounds: list[tuple[float, object]], rest: object = None) -> Column:
    """Nested pools or disjoint uses: which interval of [0, 1) the salted hash of a key lies in."""
    return by_bounds(hash_fraction(F.lit(salt), key), bounds, rest)


def capped_role(df: DataFrame, key: str, stratum: str, n: int, seed: int, inside: str, outside: str) -> DataFrame:
    """``(key, role)``: the first ``n`` keys of each stratum in hash order get one role, all others the other; by ranges, so that a large
    stratum is no task of its own."""
    hashed = df.select(key, stratum, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("_h"))
    return global_rank(hashed, ["_h", key], [stratum]).select(key, F.when(F.col("rank") <= n, inside).otherwise(outside).alias("role"))


def merged_decisions(records: DataFrame, reviews: DataFrame, key: str, decision: str, order: list[str], open_: str = "open") -> DataFrame:
    """``(key, decision)`` of every record: of several reviews the one that comes last in ``order``; ``open_`` without review. A decision
    outside ``order`` fails the query."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(decision))
    known = require(reviews, place > 0, "an unknown decision")
    last = known.groupBy(F.col(key).alias("_key")).agg(F.max(place).cast("int").alias("_place"))
    named = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in order]), F.col("_place")), F.lit(open_))
    return records.select(key).join(last, F.col(key) == F.col("_key"), "left").select(key, named.alias(decision))


def ambiguous(df: DataFrame, key: str, value: str, name: str = "values") -> DataFrame:
    """``(key, values)``: keys with more than one value; null keys are none."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias(name)).where(F.col(name) > 1)


def documents_log(origins: DataFrame, contents: DataFrame, key: str, origin: list[str], content: list[str]) -> DataFrame:
    """One row for each origin of a content with what the content was given."""
    return origins.select(key, *origin).join(contents.select(key, *content), key).select(*origin, *content).distinct()


def provenance(units: DataFrame, origins: DataFrame, contents: DataFrame, key: str, text: str, origin: list[str]) -> DataFrame:
    """Every occurrence of each text with its origin, and whether it is the one that is retained, that of the smallest content."""
    own = units.select(key, text).distinct()
    winners = own.groupBy(text).agg(F.min(key).alias("_winner"))
    all_ = own.join(winners, text).join(origins.select(key, *origin), key).join(contents.select(key), key)
    return all_.groupBy(*origin, text, (F.col(key) == F.col("_winner")).alias("retained")).agg(F.count("*").alias("n"))


def corpus_stats(units: DataFrame, text: str, text_key: str, doc_key: str, chars_a_token: dict[str, float]) -> DataFrame:
    """Units, distinct sentences and documents, characters, and estimates of tokens, rounded up for each unit."""
    n = F.length(text)
    return units.agg(F.count("*").alias("units"), F.count_distinct(text_key).alias("sentences"), F.count_distinct(doc_key).alias("docs"), F.sum(n).alias("chars"), *[F.sum(F.ceil(n / x)).alias(name) for name, x in chars_a_token.items()])


def reason_counts(decided: DataFrame, decision: str, reasons: str, none: str = "none") -> DataFrame:
    """``(decision, reason, docs)``: a document counts for each of its reasons, and for ``none`` if it has none."""
    listed = F.when(F.size(reasons) == 0, F.array(F.lit(none))).otherwise(F.col(reasons))
    return decided.select(decision, F.explode(listed).alias("reason")).groupBy(decision, "reason").agg(F.count("*").alias("docs"))


def host_stats(decided: DataFrame, host: str, decision: str, least: int, share: float) -> DataFrame:
    """``(host, docs, drops, survivors)`` of hosts with so many documents and such a share of dropped ones."""
    counted = decided.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("docs"), F.count_if(F.col(decision) == "drop").alias("drops"))
    return counted.where((F.col("docs") >= least) & (F.col("drops") >= F.lit(share) * F.col("docs"))).withColumn("survivors", F.col("docs") - F.col("drops"))


def domain_farms(docs: DataFrame, host: str, domain: Column, least_hosts: int) -> DataFrame:
    """``(domain, hosts, docs)`` of domains with so many hosts; counted by host first, so that a large domain is small."""
    by_host = docs.where(F.col(host).isNotNull()).groupBy(domain.alias("domain"), host).agg(F.count("*").alias("n"))
    return by_host.groupBy("domain").agg(F.count("*").alias("hosts"), F.sum("n").alias("docs")).where(F.col("hosts") >= least_hosts)


def sample_windows(samples: DataFrame, time: str, value: str, seconds: int) -> DataFrame:
    """Least, peak, median and number of samples in windows of so many seconds."""
    bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    return samples.groupBy(bucket.alias("bucket")).agg(F.min(value).alias("least"), F.max(value).alias("peak"), F.median(value).alias("median"), F.count("*").alias("samples"))


def overlap_summary(records: DataFrame, known: DataFrame, by: list[str], key: str) -> DataFrame:
    """Of each group the distinct keys screened, and those that ``known`` holds."""
    listed = known.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_hit")).distinct()
    return records.select(*by, key).distinct().join(listed, key, "left").groupBy(*by).agg(F.count(key).alias("screened"), F.count_if("_hit").alias("flagged"))


def usable(weights: DataFrame, group: str, value: str, weight: str, share: float) -> DataFrame:
    """``(group, value, w)``: values with at least ``share`` of their group's weight."""
    sums = weights.where(F.col(weight).isNotNull()).groupBy(group, value).agg(F.sum(weight).alias("w"))
    return sums.withColumn("_all", F.sum("w").over(Window.partitionBy(group))).where(F.col("w") >= F.lit(share) * F.col("_all")).select(group, value, "w")


def same_counters(parts: DataFrame, whole: DataFrame, key: str, count: str) -> DataFrame:
    """The summed counters of all parts; a counter that differs from the whole's, or that one side lacks, fails the query."""
    summed = parts.groupBy(key).agg(F.sum(count).alias(count))
    both = summed.join(whole.select(F.col(key).alias("_key"), F.col(count).alias("_n")), F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    return require(both, F.col(count) == F.col("_n"), "the counters of the parts and of the whole differ").select(key, count)
