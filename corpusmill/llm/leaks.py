"""Problem 7: evaluation texts leaking into training text.

Winnowing: of every window of ``WINDOW`` consecutive k-gram hashes the smallest is kept as a fingerprint. Two texts
that share ``k + WINDOW - 1`` = ``span`` folded characters share a whole window, and so a fingerprint with its place.
Fingerprints of the items are sorted once and joined with those of each document where the document is read; each hit
is extended in both directions and kept if the shared run reaches ``span``. Documents never move.

Benchmarks are small: up to ``MOST_BLOCKS`` blocks of ``BLOCK_CHARS`` characters the items are sent to the tasks, as the
small side of a hash join, and the corpus is read once for each block. A larger set of items is joined by shuffle: both
sides give each fingerprint with the characters around it, which are enough to extend a hit on the spot, and of the
documents only fingerprints that a bit map of the items' may hold are moved. Both ways give the same pairs.

Defined cases: null or short texts (under ``span`` folded characters) share nothing; repeated rows and repeated
fingerprints give one pair; a null ``item_id`` or ``doc_id`` is left out; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions.fold import code_points, fold_many, gram_keys, inside
from corpusmill.runtime import Stage

SPAN = 24
K = 12
BLOCK_CHARS = 4_000_000
MOST_BLOCKS = 8
MAP_BITS = 26  # size of the map of the items' fingerprints, where they are joined
#: Characters of a batch that are fingerprinted at once; bounds the memory of a task.
CHUNK_CHARS = 1_000_000


def winnow(points: np.ndarray, offsets: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts laid end to end, and their positions: the smallest k-gram hash of each window of each text."""
    window = span - k + 1
    key = gram_keys(points, k)
    n = len(key)
    if n < window:
        return key[:0], np.zeros(0, np.int64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = inside(offsets, span, n)  # a window starts here
    least = key.copy()
    done = 1
    while done < window:  # doubling: the minimum of `window` keys from each position on
        step = min(done, window - done)
        np.minimum(least[: n - step], least[step:].copy(), out=least[: n - step])
        done += step
    mark = np.zeros(n, bool)
    # A key is kept if it is the minimum of some whole window that holds it.
    low = np.where(full, least, most)
    for j in range(window):
        mark[j:] |= full[: n - j] & (key[j:] == low[: n - j])
    at = np.flatnonzero(mark)
    return key[at], at


def _matches(doc: np.ndarray, d0: int, d1: int, at: int, item: np.ndarray, i0: int, i1: int, it: int, span: int) -> bool:
    """Whether the run around equal positions ``at`` and ``it`` reaches ``span`` characters."""
    back = min(at - d0, it - i0, span)
    ahead = min(d1 - at, i1 - it, span)
    same = doc[at - back : at + ahead] == item[it - back : it + ahead]
    left, right = same[:back][::-1], same[back:]
    run = (int(np.argmin(left)) if not left.all() else len(left)) + (int(np.argmin(right)) if not right.all() else len(right))
    return run >= span


def _found(batches, block, k: int, span: int):
    import pyarrow as pa

    keys, places, owner, points, offsets, ids = (np.frombuffer(b, t) for b, t in block.value)
    bits = 22
    filter_ = np.zeros(1 << bits, bool)
    filter_[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out_item, out_doc = [], []
        start, size = 0, 0
        for stop in range(1, len(texts) + 1):
            size += len(texts[stop - 1] or "")
            if size < CHUNK_CHARS and stop < len(texts):
                continue
            folded = fold_many(texts[start:stop])
            whole, bounds = code_points(folded)
            key, at = winnow(whole, bounds, k, span)
            near = filter_[(key >> np.uint64(64 - bits)).astype(np.int64)]
            key, at = key[near], at[near]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            doc = np.searchsorted(bounds, at[hit], side="right") - 1
            sure: set[tuple[int, int]] = set()
            for h, d in zip(hit.tolist(), doc.tolist(), strict=True):
                for f in range(int(lo[h]), int(hi[h])):
                    o = int(owner[f])
                    if (d, o) not in sure and _matches(whole, int(bounds[d]), int(bounds[d + 1]), int(at[h]), points, int(offsets[o]), int(offsets[o + 1]), int(places[f]), span):
                        sure.add((d, o))
            for d, o in sure:
                out_doc.append(names[start + d])
                out_item.append(int(ids[o]))
            start, size = stop, 0
        yield pa.RecordBatch.from_arrays([pa.array(out_item, pa.int64()), pa.array(out_doc, pa.int64())], ["item_id", "doc_id"])


def _blocks(items: DataFrame):
    """The items in blocks of bounded size, each prepared for lookup. Items stream through the driver; one block is held."""

    def ready(rows):
        folded = fold_many([t for _, t in rows])
        points, offsets = code_points(folded)
        key, at = winnow(points, offsets, K, SPAN)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        owner = np.searchsorted(offsets, at, side="right") - 1
        columns = (key, at.astype(np.int64), owner.astype(np.int64), points, offsets, np.array([i for i, _ in rows], np.int64))
        return [(c.tobytes(), c.dtype.str) for c in columns]

    held, size = [], 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield ready(held)
            held, size = [], 0
    if held:
        yield ready(held)


def _prints(batches, k: int, span: int, known):
    """``(h, key, left, right)``: fingerprints with the ``span - k`` characters before them and ``span`` from them on."""
    import pyarrow as pa
    import zstandard

    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(known.value), np.uint8) if known else None
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start, size = 0, 0
        for stop in range(1, len(texts) + 1):
            size += len(texts[stop - 1] or "")
            if size < CHUNK_CHARS and stop < len(texts):
                continue
            folded = fold_many(texts[start:stop])
            points, offsets = code_points(folded)
            key, at = winnow(points, offsets, k, span)
            if bits is not None:
                cell = (key >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                near = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                key, at = key[near], at[near]
            who = np.searchsorted(offsets, at, side="right") - 1
            rows = [(names[start + w], folded[w][max(0, p - span + k) : p], folded[w][p : p + span]) for w, p in zip(who.tolist(), (at - offsets[who]).tolist(), strict=True)]
            for n in range(0, len(rows), 20_000):
                ids, left, right = zip(*rows[n : n + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[n : n + 20_000].view(np.int64)), pa.array(ids, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["h", "key", "left", "right"])
            start, size = stop, 0


def _cells(batches):
    """The map of fingerprints of a task: one compressed row."""
    import pyarrow as pa
    import zstandard

    seen = np.zeros(1 << MAP_BITS, bool)
    for batch in batches:
        seen[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(seen).tobytes())], pa.binary())], ["bits"])


def _shared(left: str, right: str) -> int:
    n = min(len(left), len(right))
    return next((i for i in range(n) if left[i] != right[i]), n)


def _extended(batches, span: int):
    import pyarrow as pa

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        keep = [i for i, (_, _, a, b, c, d) in enumerate(zip(*columns, strict=True)) if _shared(a[::-1], c[::-1]) + _shared(b, d) >= span]
        yield batch.take(pa.array(keep, pa.int64())).select([0, 1])


def _joined(texts: DataFrame, items: DataFrame, k: int, span: int) -> DataFrame:
    """Fingerprints of items and documents joined by shuffle; see above."""
    import zstandard

    spark, kind = texts.sparkSession, "h bigint, key bigint, left string, right string"
    mine = Stage(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().mapInArrow(lambda b: _prints(b, k, span, None), kind), "prints").df
    whole = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in mine.select("h").mapInArrow(_cells, "bits binary").toLocalIterator():  # one map of fixed size at a time
        whole |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row[0])), np.uint8)
    known = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(whole.tobytes()))
    theirs = texts.mapInArrow(lambda b: _prints(b, k, span, known), kind)
    hits = mine.withColumnsRenamed({"key": "item_id", "left": "l", "right": "r"}).join(theirs.withColumnRenamed("key", "doc_id"), "h")
    return hits.select("item_id", "doc_id", "l", "r", "left", "right").mapInArrow(lambda b: _extended(b, span), "item_id bigint, doc_id bigint").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``(item_id, doc_id)``: documents that share a run of at least ``span`` folded characters with an item."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    size = items.where("item_id is not null").agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_BLOCKS * BLOCK_CHARS:
        return _joined(texts, items, k, span)
    out = None
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)
        found = texts.mapInArrow(lambda b, sent=sent: _found(b, sent, k, span), "item_id bigint, doc_id bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint")
    return out.distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Of each suite its items, those that leaked, and the documents that hold them."""
    found = leaked_items(documents, items)
    suites = items.select("item_id", F.coalesce("suite", F.lit("none")).alias("suite")).distinct()
    return suites.join(found, "item_id", "left").groupBy("suite").agg(F.count_distinct("item_id").alias("items"), F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked_items"), F.count_distinct("doc_id").alias("documents"))
