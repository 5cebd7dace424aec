"""Problem 1: splits that keep related records together.

Contents are tied by a group, or by an id, address or author key. The ties are a graph of contents and keys; its
components come from local union-find forests merged level by level (``operators.components``). Components are then
given to the splits largest first, each to the split furthest below its target. Components of one size are
interchangeable, so the greedy rule runs over the histogram of sizes, which has at most sqrt(2 n) entries, and a
distributed rank inside each size turns its quotas into members; no task or driver ever holds the components.

Defined cases: null group and null, empty or bare-prefix keys tie nothing; aliases of hashes that ``contents`` lacks
tie nothing; repeated rows change nothing; a null ``doc_hash`` is left out; empty tables give empty results; a content
without ``docs`` rows still gets a split; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import strip
from corpusmill.operators.components import connected_components
from corpusmill.runtime import Stage

#: Split names in the order of ``contents.split_rank``.
SPLITS = ("train", "validation", "test")
PROPORTIONS = (0.98, 0.01, 0.01)
#: Buckets in which components of one size are ranked, so that the many singletons do not meet in one task.
RANK_BUCKETS = 4096


def alias_identity(key: Column) -> Column:
    """The form in which alias keys compare; null if the key names nothing."""
    prefix = F.regexp_extract(key, r"^([A-Za-z]+:)", 1)
    rest = F.substring(key, F.length(prefix) + F.lit(1), F.lit(1 << 30))
    bare = strip(rest)
    uncut = F.substring_index(bare, "#", 1)
    head = F.regexp_extract(uncut, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", 0)
    url = F.concat(F.lower(head), F.substring(uncut, F.length(head) + 1, F.lit(1 << 30)))
    value = F.when(prefix == "url:", F.concat(F.lit("url:"), url)).otherwise(key)
    named = F.when(prefix == "url:", F.length(url) > 0).otherwise(F.length(bare) > 0)
    return F.when(key.isNotNull() & (F.length(key) > 0) & named, value)


def _vertex(space: str, value: Column) -> Column:
    """16 bytes that stand for a name; md5 keeps the graph narrow and collisions out of reach."""
    return F.unhex(F.md5(F.concat(F.lit(space), value).cast("binary")))


def related(contents: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(doc_hash, v, root)``: every content once, with the vertex ``root`` shared by all contents related to it."""
    docs = contents.where("doc_hash is not null").select("doc_hash", "group_id")
    known = docs.select("doc_hash").distinct()
    by_key = aliases.select(alias_identity(F.col("alias_key")).alias("k"), "doc_hash").where("k is not null").join(known, "doc_hash", "left_semi").select(_vertex("k", F.col("k")).alias("a"), _vertex("d", F.col("doc_hash")).alias("b"))
    by_group = docs.where("group_id is not null").select(_vertex("g", F.col("group_id")).alias("a"), _vertex("d", F.col("doc_hash")).alias("b"))
    roots = connected_components(by_key.unionByName(by_group))
    return known.withColumn("v", _vertex("d", F.col("doc_hash"))).join(roots, "v", "left").select("doc_hash", "v", F.coalesce("root", "v").alias("root"))


def broken_ties(contents: DataFrame, aliases: DataFrame, docs: DataFrame) -> DataFrame:
    """``(root_hash, doc_hash)``: the contents of related sets whose stored splits, taken together, name more than one."""
    names = F.create_map(*[x for i, s in enumerate(SPLITS) for x in (F.lit(i), F.lit(s))])
    ranks = contents.select("doc_hash", F.when(F.col("split_rank").isNotNull(), F.coalesce(names[F.col("split_rank")], F.col("split_rank").cast("string"))).alias("s"))
    kept = docs.select(F.col("id").alias("doc_hash"), F.col("split").alias("s"))
    stored = ranks.unionByName(kept).where("doc_hash is not null and s is not null").groupBy("doc_hash").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    members = Stage(related(contents, aliases).join(stored, "doc_hash", "left"), "ties").df
    broken = members.groupBy("root").agg(F.min("doc_hash").alias("root_hash"), F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1 and lo < hi")
    return members.join(broken.select("root", "root_hash"), "root").select("root_hash", "doc_hash")


def quotas(histogram: dict[int, int], proportions: tuple[float, ...]) -> dict[int, list[int]]:
    """How many components of each size go to each split.

    The same as giving components one by one, largest first, to the split furthest below its target (ties: the
    earlier split): among the values ``deficit - j * size`` of all splits, the largest ``count`` are taken.
    """
    total = sum(s * c for s, c in histogram.items())
    deficit = [p / sum(proportions) * total for p in proportions]
    out: dict[int, list[int]] = {}
    for size in sorted(histogram, reverse=True):
        count = histogram[size]
        over = lambda level: sum(max(0, math.floor((d - level) / size) + 1) for d in deficit)
        lo, hi = min(deficit) - size * (count + 1), max(deficit) + size  # over(lo) >= count > over(hi)
        for _ in range(200):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if over(mid) >= count else (lo, mid)
        take = [max(0, math.floor((d - hi) / size) + 1) for d in deficit]
        for _ in range(count - sum(take)):  # ties at the level: one for each split at most
            i = max(range(len(deficit)), key=lambda i: (deficit[i] - take[i] * size, -i))
            take[i] += 1
        out[size] = take
        deficit = [d - n * size for d, n in zip(deficit, take, strict=True)]
    return out


def assign_splits(contents: DataFrame, aliases: DataFrame, docs: DataFrame, proportions: tuple[float, ...] = PROPORTIONS, seed: int = 42) -> DataFrame:
    """``(doc_hash, root_hash, split, docs_rows)``: every content once; related contents share ``root_hash`` and split.

    The size of a component is its number of contents. ``docs_rows`` counts the distinct ``docs`` rows of the content.
    """
    members = Stage(related(contents, aliases), "related").df
    groups = Stage(members.groupBy("root").agg(F.min("doc_hash").alias("root_hash"), F.count("*").alias("size")).withColumn("h", F.xxhash64(F.lit(seed), "root_hash")).withColumn("bucket", F.pmod("h", F.lit(RANK_BUCKETS))), "groups").df
    counts = groups.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    per_size = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most sqrt(2 n) rows
    rows = [(size, *take) for size, take in quotas(per_size, proportions).items()]
    spark = contents.sparkSession
    limits = spark.createDataFrame(rows or [(0, *([0] * len(proportions)))], "size bigint, " + ", ".join(f"q{i} bigint" for i in range(len(proportions))))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(limits, "size")
    here = Window.partitionBy("size", "bucket").orderBy("h", "root_hash")
    ranked = groups.join(offsets, ["size", "bucket"]).withColumn("r", F.col("base") + F.row_number().over(here) - 1)
    split, until = F.lit(SPLITS[-1]), F.lit(0)
    choice = None
    for i, name in enumerate(SPLITS):
        until = until + F.col(f"q{i}")
        choice = F.when(F.col("r") < until, name) if choice is None else choice.when(F.col("r") < until, name)
    placed = ranked.select("root", "root_hash", choice.otherwise(split).alias("split"))
    held = docs.select(*[c for c in ("id", "split", "pool", "source", "priority", "pairs") if c in docs.columns]).distinct().groupBy(F.col("id").alias("doc_hash")).agg(F.count("*").alias("docs_rows"))
    return members.join(placed, "root").join(held, "doc_hash", "left").select("doc_hash", "root_hash", "split", F.coalesce("docs_rows", F.lit(0)).alias("docs_rows"))


def split_shares(assigned: DataFrame, proportions: tuple[float, ...] = PROPORTIONS) -> DataFrame:
    """Contents, components and ``docs`` rows of each split beside its target share."""
    target = F.create_map(*[x for s, p in zip(SPLITS, proportions, strict=True) for x in (F.lit(s), F.lit(p / sum(proportions)))])
    total = Window.partitionBy()  # three rows
    sums = assigned.groupBy("split").agg(F.count("*").alias("contents"), F.sum((F.col("doc_hash") == F.col("root_hash")).cast("bigint")).alias("components"), F.sum("docs_rows").alias("docs_rows"))
    return sums.select("split", "contents", "components", "docs_rows", target[F.col("split")].alias("target_share"), (F.col("contents") / F.sum("contents").over(total)).alias("share"))
