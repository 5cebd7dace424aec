"""Duplicates, groups and splits of records, and samples that do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import hash_fraction
from corpusmill.runtime import Stage, shuffle_partitions


def primary(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def against_earlier(new: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key an earlier export lacks."""
    return new.join(earlier.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def split_by_hash(root: Column, seed: int, train: float, validation: float) -> Column:
    u = hash_fraction(F.lit(f"{seed}:"), root)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def hash_share(share: float, *key: Column) -> Column:
    return hash_fraction(*key) < share


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows with ``_b``, the number of the range of ``keys`` they lie in; ranges are of like size, and written, so they stay."""
    parts = shuffle_partitions(df.sparkSession)
    return Stage(df.repartitionByRange(parts, *keys).withColumn("_b", F.spark_partition_id()), "ranged").df


def _columns(names: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def global_rank(df: DataFrame, order: list, by: list[str] | None = None, size: str | None = None) -> DataFrame:
    """``rank`` from 1 in one order, of all rows or of each group of ``by``, without a task that sees them all.

    Rows are cut into ranges of the order; ranks inside a range are added to the sizes of the ranges before it.
    ``order`` must be total. ``size`` names a column for the number of rows of the group.
    """
    by, order = by or [], _columns(order)
    marked = _ranged(df, [*_columns(by), *order])
    sizes = marked.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    more = [F.sum("_n").over(Window.partitionBy(*by)).alias("_size")] if size else []
    base = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), *more)
    inner = Window.partitionBy(*by, "_b").orderBy(*order)
    joined = _join(marked.withColumn("_r", F.row_number().over(inner)), base, by)
    ranked = joined.withColumn("rank", F.col("_base") + F.col("_r"))
    return (ranked.withColumn(size, F.col("_size")) if size else ranked).drop("_b", "_r", "_base", "_size")


def running_total(df: DataFrame, value: str, order: list, by: list[str] | None = None, name: str = "running") -> DataFrame:
    """Inclusive running sum in one order, of all rows or of each group of ``by``, cut into ranges as in ``global_rank``."""
    by, order = by or [], _columns(order)
    marked = _ranged(df, [*_columns(by), *order])
    sizes = marked.groupBy(*by, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join(marked.withColumn("_r", F.sum(value).over(inner)), base, by)
    return joined.withColumn(name, F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")


def _join(rows: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """Joined on range and group; a null group is a group like any other."""
    other = base.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_b2"), *[c for c in ("_base", "_size") if c in base.columns])
    same = rows["_b"] == other["_b2"]
    for c in by:
        same = same & rows[c].eqNullSafe(other[f"_{c}"])
    return rows.join(other, same).drop("_b2", *[f"_{c}" for c in by])


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """``(name, quantile)``: of each share the value of rank ceil(share n), null where there is none; from the histogram of values, by ranges."""
    h = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    c = Stage(running_total(h, "n", [value], name="upto"), "histogram").df
    wanted = c.agg(F.max("upto").alias("all")).select("all", F.explode(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])).alias("name", "share"))
    found = c.crossJoin(F.broadcast(wanted)).where(F.col("upto") >= F.ceil(F.col("all") * F.col("share")))  # one row for each share
    return F.broadcast(wanted).select("name").join(found.groupBy("name").agg(F.min(value).alias("quantile")), "name", "left")


def exact_quantile(df: DataFrame, value: str, share: float) -> DataFrame:
    """The value of rank ceil(share n)."""
    return exact_quantiles(df, value, {"q": share}).select("quantile")


def budget_walk(df: DataFrame, by: str, value: str, order: list, budget: int) -> DataFrame:
    """Rows of each group taken in ``order`` while they fit into the budget, larger ones skipped; values must be positive.

    A round takes the longest prefix that fits of the rows that could still fit; the first row that does not is out, and
    what is left of the budget decides which later rows go on. Rounds run over ranges, so no task walks a group.
    """
    rows = Stage(df.where(F.col(value) <= budget).withColumn("_room", F.lit(budget).cast("bigint")), "walk").df
    out = None
    while rows.limit(1).count():
        run = Stage(global_rank(running_total(rows, value, order, [by], "_run"), order, [by]), "walked").df
        fits = F.col("_run") <= F.col("_room")
        taken = run.where(fits)
        out = taken.select(*df.columns) if out is None else out.unionByName(taken.select(*df.columns))
        state = run.groupBy(F.col(by).alias("_g")).agg(F.max(F.when(fits, F.col("_run"))).alias("_used"), F.min(F.when(~fits, F.col("rank"))).alias("_stop"))
        later = run.join(state, run[by].eqNullSafe(state["_g"])).where(F.col("rank") > F.col("_stop"))
        left = F.col("_room") - F.coalesce("_used", F.lit(0))
        rows = Stage(later.withColumn("_room", left).where(F.col(value) <= F.col("_room")).select(*df.columns, "_room"), "walk").df
    return out if out is not None else df.limit(0)
