"""Joins beyond equality: domains, containment, anchors, intervals, aligned pairs. Each is an equi-join after a rewrite,
or a scan with an automaton whose size is bounded; none compares all rows with all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corpusmill.functions.fold import code_points, gram_keys, inside
from corpusmill.functions.text import char_grams
from corpusmill.operators.annotations import require

#: Characters of patterns in one automaton; more patterns make more passes.
AUTOMATON_CHARS = 4_000_000


def domain_join(rows: DataFrame, host: str, domains: DataFrame, domain: str) -> DataFrame:
    """Rows whose host is a listed domain or lies under one; an equi-join on every suffix of the host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return rows.withColumn("_suffix", F.explode(suffixes)).join(domains.withColumnRenamed(domain, "_suffix"), "_suffix").withColumnRenamed("_suffix", domain)


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern_key: str, pattern: str) -> DataFrame:
    """``(key, pattern_key)`` wherever a text holds a pattern; texts are scanned where they lie, once for each block of patterns."""
    spark = texts.sparkSession
    kinds = f"{key} {texts.schema[key].dataType.simpleString()}, {pattern_key} {patterns.schema[pattern_key].dataType.simpleString()}"
    rows = texts.select(key, text).where(F.col(text).isNotNull())
    name_type = to_arrow_type(patterns.schema[pattern_key].dataType)

    def scan(words):
        def over(batches):
            import ahocorasick
            import pyarrow as pa

            machine = ahocorasick.Automaton()
            for name, p in words.value:
                if p in machine:
                    machine.get(p).append(name)
                else:
                    machine.add_word(p, [name])
            machine.make_automaton()
            for batch in batches:
                found = [(k, n) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n in {n for _, names in machine.iter(t) for n in names}]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], batch.schema.field(0).type), pa.array([n for _, n in found], name_type)], [key, pattern_key])

        return over

    out, held, size = None, [], 0

    def flush():
        nonlocal out, held, size
        found = rows.mapInArrow(scan(spark.sparkContext.broadcast(held)), kinds)
        out, held, size = found if out is None else out.unionByName(found), [], 0

    for r in patterns.select(pattern_key, pattern).where(F.length(pattern) > 0).distinct().toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= AUTOMATON_CHARS:
            flush()
    if held:
        flush()
    return out.distinct() if out is not None else spark.createDataFrame([], kinds)


#: Blocks of items that are sent to the texts; a larger set of items is joined by gram instead.
MOST_BLOCKS = 16


def _item_blocks(items: DataFrame, key: str, text: str, n: int):
    """Items of ``n`` characters or more in blocks of bounded size; null if there are more than ``MOST_BLOCKS``."""
    blocks, held, size = [], [], 0
    for r in items.select(key, text).where(F.length(text) >= n).distinct().toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= AUTOMATON_CHARS:
            blocks.append(held)
            held, size = [], 0
            if len(blocks) == MOST_BLOCKS:
                return None
    return [*blocks, held] if held else blocks


def _scan_grams(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, blocks: list, n: int, whole: bool) -> DataFrame:
    """Texts are scanned where they lie: integer keys of their n-grams are looked up among the sorted keys of a block's grams,
    and only hits are compared as strings. ``whole``: the items whose first gram is hit and that stand there in full."""
    spark = texts.sparkSession
    kinds = f"{key} {texts.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}, shared bigint"
    name_type = to_arrow_type(items.schema[item_key].dataType)
    rows = texts.select(key, text).where(F.length(text) >= n)

    def scan(sent):
        def over(batches):
            import pyarrow as pa

            of: dict[str, list[int]] = {}
            for i, (_, x) in enumerate(sent.value):
                for g in {x[:n]} if whole else {x[j : j + n] for j in range(len(x) - n + 1)}:
                    of.setdefault(g, []).append(i)
            grams = list(of)
            known = np.unique(gram_keys(code_points(grams)[0], n)[np.arange(len(grams)) * n]) if grams else np.zeros(0, np.uint64)
            for batch in batches:
                texts_ = batch.column(1).to_pylist()
                points, offsets = code_points(texts_)
                keys = gram_keys(points, n)
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                at = np.flatnonzero((known[place] == keys) & inside(offsets, n, len(keys)))
                who = np.searchsorted(offsets, at, side="right") - 1
                count: dict[tuple[int, int], set] = {}
                for w, p in zip(who.tolist(), (at - offsets[who]).tolist(), strict=True):
                    g = texts_[w][p : p + n]
                    for i in of.get(g, ()):
                        if not whole or texts_[w].startswith(sent.value[i][1], p):
                            count.setdefault((w, i), set()).add(g)
                names = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([names[w] for w, _ in count], batch.schema.field(0).type), pa.array([sent.value[i][0] for _, i in count], name_type), pa.array([len(g) for g in count.values()], pa.int64())], [key, item_key, "shared"])

        return over

    out = None
    for block in blocks:
        found = rows.mapInArrow(scan(spark.sparkContext.broadcast(block)), kinds)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], kinds)


def gram_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str, n: int) -> DataFrame:
    """``(left_key, right_key, shared)``: the number of distinct n-grams two texts share, at least one."""
    a = left.select(left_key, F.explode(F.array_distinct(char_grams(F.col(text), n))).alias("_g"))
    b = right.select(right_key, F.explode(F.array_distinct(char_grams(F.col(text), n))).alias("_g"))
    return a.join(b, "_g").groupBy(left_key, right_key).agg(F.count("*").alias("shared"))


def shared_grams(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int) -> DataFrame:
    """As ``gram_join``, for a set of items small enough to be sent to the texts; a larger one is joined. Keys must be unique."""
    blocks = _item_blocks(items, item_key, item_text, n)
    if blocks is None:
        return gram_join(texts, key, items.withColumnRenamed(item_text, text), item_key, text, n)
    return _scan_grams(texts, key, text, items, item_key, blocks, n, False)


def gram_jaccard(texts: DataFrame, key: str, text: str, n: int, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of similar texts by n-grams; of each text the n - ceil(least n) + 1 rarest grams are joined, which loses none."""
    grams = texts.select(F.col(key).alias("k"), F.array_distinct(char_grams(F.col(text), n)).alias("g")).where(F.size("g") > 0)
    each = grams.select("k", F.size("g").alias("n"), F.explode("g").alias("x"))
    df = each.groupBy("x").agg(F.count("*").alias("df"))
    order = Window.partitionBy("k").orderBy("df", "x")
    rare = each.join(df, "x").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).select("k", "x")
    pairs = rare.alias("p").join(rare.alias("q"), F.expr("p.x = q.x and p.k < q.k")).select(F.col("p.k").alias("a"), F.col("q.k").alias("b")).distinct()
    side = lambda c: grams.select(F.col("k").alias(c), F.col("g").alias(f"g{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("shared"), F.size(F.array_union("ga", "gb")).alias("all"))
    return both.where(F.col("shared") >= F.col("all") * least)


def anchor_join(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int) -> DataFrame:
    """``(key, item_key)`` wherever a text holds an item of at least ``n`` characters: the item's first ``n`` characters are
    looked up among the text's n-grams, and hits are checked on the spot; only a very large set of items is joined."""
    blocks = _item_blocks(items, item_key, item_text, n)
    if blocks is not None:
        return _scan_grams(texts, key, text, items, item_key, blocks, n, True).select(key, item_key).distinct()
    anchors = items.where(F.length(item_text) >= n).select(item_key, F.col(item_text).alias("_item"), F.substring(item_text, 1, n).alias("_g"))
    grams = texts.select(key, F.explode(F.array_distinct(char_grams(F.col(text), n))).alias("_g"))
    hits = grams.join(anchors, "_g").join(texts.select(key, text), key)
    return hits.where(F.contains(F.col(text), F.col("_item"))).select(key, item_key).distinct()


def aligned(left: DataFrame, right: DataFrame, key: str, equal: list[str]) -> DataFrame:
    """Two result tables joined by key; a key on one side only, or a difference in ``equal``, fails the query."""
    both = left.alias("l").join(right.alias("r"), key, "full_outer")
    same = F.lit(True)
    for c in equal:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    present = F.col(f"l.{equal[0]}").isNotNull() & F.col(f"r.{equal[0]}").isNotNull() if equal else F.lit(True)
    return require(both, present & same, "aligned: the tables do not pair")


def union_length(intervals: DataFrame, start: str, end: str, *group: str) -> DataFrame:
    """Covered length and islands of each group's intervals."""
    order = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where(F.col(end) > F.col(start)).withColumn("_reach", reach)
    new = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start))))
    return marked.groupBy(*group).agg(F.sum(gain).alias("covered"), F.count_if(new).alias("islands"))


def clipped(intervals: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    return intervals.withColumns({start: F.greatest(start, lo), end: F.least(end, hi)}).where(F.col(start) < F.col(end))
