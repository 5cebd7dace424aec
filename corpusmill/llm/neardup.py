"""Problem 3: near-duplicate records with small edits.

Banded MinHash signatures bring up candidates; a sequential Bayesian test compares them batch of signature rows by
batch and drops a pair as soon as the posterior probability that its similarity reaches the threshold falls below the
chosen miss probability; survivors are verified exactly; verified links become groups by connected components.

Exact copies (one folded text) are one class, banded once. A band bucket of up to ``RUN`` distinct texts gives all its
pairs. In a larger one all members are compared with a leader; where all are like it, as in a crowd of near copies, the
bucket is done, for its members are one group. The others are split by further signature rows (``SUB_BANDS``
alternatives, so that similar texts still meet); a part that stays large holds near-identical texts, which are compared
with a leader, those unlike it with the next leader, and so on, until all its members are linked or at most ``RUN`` are
left, which are compared pairwise. A member unlike a leader is compared with those like it too, except where the exact
similarities to the leader rule a link out: 1 - similarity is a metric. Nothing is dropped by size.

Defined cases: contents shorter than ``min_chars`` folded characters belong to no group; null texts count as empty;
null positions sort first; whole repeated rows count once; a null ``doc_hash`` is left out; empty tables give no rows.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions.fold import code_points, fold_many, gram_keys, grams, mix64
from corpusmill.llm import runs
from corpusmill.operators.components import connected_components
from corpusmill.runtime import Stage, shuffle_partitions

ROWS = 128  # MinHash rows of a signature, 16 bits each
BANDS, BAND_ROWS = 48, 6  # at similarity 0.7: 1 - (1 - 0.7 ** 6) ** 48 = 0.9975 of pairs become candidates
SUB_BANDS, SUB_ROWS = 28, 4  # at similarity 0.7: 0.9994 of the pairs of a split bucket meet again
RUN = 64  # members of a bucket that are compared pairwise
BATCH = 16  # signature rows of one Bayesian step
MISS = 1e-4  # posterior probability of a similar pair below which it is dropped
THRESHOLD = 0.7


@functools.cache
def _family():
    draw = np.random.Generator(np.random.PCG64(20310301))
    xor = draw.integers(0, 1 << 32, ROWS, dtype=np.uint32)[:, None]
    odd = (draw.integers(0, 1 << 32, ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
    bands = np.stack([draw.permutation(ROWS)[:BAND_ROWS] for _ in range(BANDS)])
    subs = np.stack([draw.permutation(ROWS)[:SUB_ROWS] for _ in range(SUB_BANDS)])
    return xor, odd, bands, subs


def signature(keys: np.ndarray) -> np.ndarray:
    """The MinHash rows of a set of gram keys; repeated keys change nothing."""
    xor, odd, _, _ = _family()
    h = (mix64(keys) >> np.uint64(32)).astype(np.uint32)
    low = np.full(ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        np.minimum(low, ((h[None, at : at + 4096] ^ xor) * odd).min(axis=1), out=low)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype(np.uint16)


@functools.cache
def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> list[int]:
    """For 16, 32, ... compared rows: the fewest matches with P(similarity >= threshold | matches) >= miss, uniform prior."""
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(BATCH, ROWS + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            w = np.exp(logs - logs.max())
            if w[s >= threshold].sum() / w.sum() >= miss:
                break
        out.append(m)
    return out


def _texts(batches, min_chars: int):
    """Streams rows sorted by document and position into one signed row for each document."""
    import pyarrow as pa
    import xxhash
    from pyspark import TaskContext

    next_id = TaskContext.get().partitionId() << 40
    names, parts, texts, size = [], [], [], 0
    current, last, parts = None, None, []

    def flush():
        nonlocal next_id, size
        folded = fold_many(texts)
        rows = [(d, f) for d, f in zip(names, folded, strict=True) if len(f) >= min_chars]
        names.clear(), texts.clear()
        size = 0
        points, offsets = code_points([f for _, f in rows])
        keys = gram_keys(points, 3)
        sigs = [signature(keys[offsets[i] : offsets[i + 1] - 2]).tobytes() for i in range(len(rows))]
        ids = list(range(next_id, next_id + len(rows)))
        next_id += len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([d for d, _ in rows], pa.string()), pa.array([xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass")) for _, f in rows], pa.binary()), pa.array(sigs, pa.binary()), pa.array([f for _, f in rows], pa.string())],
            ["id", "doc_hash", "key", "sig", "text"],
        )

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[0] != current:
                if current is not None:
                    names.append(current)
                    texts.append("".join(parts))
                    size += len(texts[-1])
                    if size > 1_000_000:
                        yield flush()
                current, last, parts = row[0], None, []
            if row != last:
                parts.append(row[3] or "")
                last = row
    if current is not None:
        names.append(current)
        texts.append("".join(parts))
        yield flush()


def content_texts(units: DataFrame, min_chars: int = 100) -> DataFrame:
    """``(id, doc_hash, key, sig, text)`` of each content long enough; ``text`` is folded, ``key`` its digest. Write it before use: ids depend on the partitions."""
    rows = units.where("doc_hash is not null").select("doc_hash", "paragraph_index", "sentence_index", "text", F.xxhash64("text_hash", "spans", "annotation_ids").alias("h"))
    ordered = rows.repartition(shuffle_partitions(units.sparkSession), "doc_hash").sortWithinPartitions("doc_hash", "paragraph_index", "sentence_index", "text", "h")
    return ordered.mapInArrow(lambda b: _texts(b, min_chars), "id bigint, doc_hash string, key binary, sig binary, text string")


def _band_keys(sig: np.ndarray, rows: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys of shape (texts, bands); salt: (texts, bands) or (bands,)."""
    key = np.broadcast_to(salt, (len(sig), len(rows))).astype(np.uint64)
    for j in range(rows.shape[1]):
        key = (key ^ sig[:, rows[:, j]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return mix64(key)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, ROWS)


def _send_bands(batches, buckets: int):
    import pyarrow as pa

    bands = _family()[2]
    held, size = [], 0

    def flush():
        ids = np.concatenate([i for i, _ in held])
        keys = np.concatenate([k for _, k in held])
        held.clear()
        key, who = keys.ravel(), np.repeat(ids, BANDS)
        out = list(runs.scatter([key, who], runs.bucket_of(key, buckets)))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy().astype(np.uint64), _band_keys(_sigs(batch.column(1)), bands, np.arange(BANDS, dtype=np.uint64))))
            size += batch.num_rows
            if size >= 40_000:
                yield flush()
                size = 0
    if held:
        yield flush()


def _meet(batches):
    """Pairs of the small runs of each bucket; of the larger runs each member, with the run's key and no partner."""
    import pyarrow as pa

    for key, who in runs.gather(batches, 2):
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(key)])
        small = sizes <= RUN
        i, j = runs.run_pairs(first[small], sizes[small])
        pairs = np.unique(np.stack([who[i], who[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.uint64)
        hot = np.repeat(~small, sizes)
        n, m = len(pairs), int(hot.sum())
        a = np.r_[pairs[:, 0], who[hot]].astype(np.int64)
        b = pa.array(np.r_[pairs[:, 1], np.zeros(m, np.uint64)].astype(np.int64), mask=np.r_[np.zeros(n, bool), np.ones(m, bool)])
        run = pa.array(np.r_[np.zeros(n, np.uint64), key[hot]].view(np.int64))
        whole = pa.RecordBatch.from_arrays([pa.array(a), b, run], ["a", "b", "run"])
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)


_MET = "a bigint, b bigint, run bigint"


def _send_sub_bands(batches, buckets: int):
    import pyarrow as pa

    subs = _family()[3]
    for batch in batches:
        if batch.num_rows:
            run = batch.column(0).to_numpy().view(np.uint64)
            key = _band_keys(_sigs(batch.column(2)), subs, run[:, None] + np.arange(SUB_BANDS, dtype=np.uint64)[None, :]).ravel()
            out = list(runs.scatter([key, np.repeat(batch.column(1).to_numpy().astype(np.uint64), SUB_BANDS)], runs.bucket_of(key, buckets)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])


def _posterior(batches, threshold: float, miss: float):
    """Keeps the pairs that no batch of signature rows rules out."""
    import pyarrow as pa

    least = least_matches(threshold, miss)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _sigs(batch.column(2)), _sigs(batch.column(3))
        alive = np.arange(len(x))
        seen = np.zeros(len(x), np.int64)
        for step, need in enumerate(least):
            rows = slice(step * BATCH, (step + 1) * BATCH)
            seen[alive] += (x[alive, rows] == y[alive, rows]).sum(1)
            alive = alive[seen[alive] >= need]
        yield batch.take(pa.array(alive)).select([0, 1])


def _exact(batches, threshold: float):
    import pyarrow as pa

    for batch in batches:
        known: dict[str, np.ndarray] = {}

        def of(t, known=known):
            if t not in known:
                known[t] = grams(t)
            return known[t]

        keep = []
        for i, (s, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            u, v = of(s), of(t)
            both = len(np.intersect1d(u, v, assume_unique=True))
            if both and both >= threshold * (len(u) + len(v) - both) - 1e-9:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())).select([0, 1])


def _distances(batches):
    """Of each pair of texts 1 - similarity, which is a metric."""
    import pyarrow as pa

    for batch in batches:
        known: dict[str, np.ndarray] = {}

        def of(t, known=known):
            if t not in known:
                known[t] = grams(t)
            return known[t]

        apart = []
        for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            u, v = of(s), of(t)
            both = len(np.intersect1d(u, v, assume_unique=True))
            apart.append(1 - both / max(1, len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart, pa.float64())], ["a", "b", "apart"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Of candidate pairs ``(a, b)`` those of exact similarity ``threshold`` or more."""
    side = lambda name, column: texts.select(F.col("id").alias(name), F.col(column).alias(f"{column}_{name}"))
    signed = pairs.join(side("a", "sig"), "a").join(side("b", "sig"), "b").select("a", "b", "sig_a", "sig_b")
    likely = signed.mapInArrow(lambda x: _posterior(x, threshold, miss), "a bigint, b bigint")
    read = likely.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return read.mapInArrow(lambda x: _exact(x, threshold), "a bigint, b bigint")


def links(banded: DataFrame, texts: DataFrame, rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Verified pairs ``(a, b)`` of ids among the texts of ``banded`` (id, sig), which differ; ``texts`` (id, sig, text) is written."""
    spark = texts.sparkSession
    least = shuffle_partitions(spark)
    buckets = runs.buckets_for(rows * BANDS, 2, least)
    sent = banded.select("id", "sig").mapInArrow(lambda b: _send_bands(b, buckets), "bucket int, blob binary").repartitionById(buckets, F.col("bucket"))
    met = Stage(sent.mapInArrow(_meet, _MET), "met")
    pairs = met.df.where("b is not null").select("a", "b")
    hot = met.df.where("b is null").select("run", "a")
    found = []
    n = hot.count()
    if n:
        led = hot.join(hot.groupBy("run").agg(F.min("a").alias("b")), "run").where("a <> b")
        crowd = Stage(verified(led.select("a", "b").distinct(), texts, threshold, miss), "crowd")
        found.append(crowd.df)
        mixed = led.join(crowd.df, ["a", "b"], "left_anti").select("run").distinct()
        hot = Stage(hot.join(mixed, "run", "left_semi"), "mixed").df
        n = hot.count()
    if n:
        cut = runs.buckets_for(n * SUB_BANDS, 2, least)
        signed = hot.join(texts.select(F.col("id").alias("a"), "sig"), "a").select("run", "a", "sig")
        again = Stage(signed.mapInArrow(lambda b: _send_sub_bands(b, cut), "bucket int, blob binary").repartitionById(cut, F.col("bucket")).mapInArrow(_meet, _MET), "split")
        pairs = pairs.unionByName(again.df.where("b is not null").select("a", "b"))
        alike = again.df.where("b is null").select("run", "a")
        side = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
        most = 1 - threshold + 1e-9
        while alike.limit(1).count():  # each round a leader for each run; members like it are done
            lead = alike.groupBy("run").agg(F.min("a").alias("b"), F.count("*").alias("n"))
            led = alike.join(lead, "run")
            few = led.where("n <= %d" % RUN).select("run", "a")
            pairs = pairs.unionByName(few.join(few.select("run", F.col("a").alias("c")), "run").where("a < c").select("a", F.col("c").alias("b")))
            many = led.where("n > %d and a <> b" % RUN).select("run", "a", "b")
            read = many.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
            apart = Stage(read.mapInArrow(_distances, "a bigint, b bigint, apart double"), "apart").df
            found.append(apart.where(F.col("apart") <= most).select("a", "b"))
            placed = Stage(many.join(apart, ["a", "b"]).select("run", "a", "apart"), "star").df
            unlike = placed.where(F.col("apart") > most)
            # A text like one that is like the leader is within twice the distance of it, and no further from the leader than the two steps.
            near = placed.where(F.col("apart") <= most).select("run", F.col("a").alias("c"), F.col("apart").alias("step"))
            cross = unlike.where(F.col("apart") <= 2 * most).join(near, "run").where(F.col("apart") - F.col("step") <= most)
            pairs = pairs.unionByName(cross.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")))
            alike = Stage(unlike.select("run", "a"), "alike").df
    out = verified(pairs.distinct(), texts, threshold, miss)
    for more in found:
        out = out.unionByName(more)
    return out


def near_duplicates(units: DataFrame, min_chars: int = 100, threshold: float = THRESHOLD, miss: float = MISS, count_links: bool = False) -> DataFrame:
    """``(doc_hash, class_key, group_id)``, and ``links`` if wanted: one row per content that has a near or exact duplicate.

    ``class_key`` is common to exact copies, ``group_id`` to all that are linked, directly or through others;
    ``links``, only with ``count_links``, is the number of different texts linked directly to the content's own: all pairs
    of a group are compared, for candidates bring up only as many as groups need.
    """
    texts = Stage(content_texts(units, min_chars), "texts").df
    classes = texts.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = classes.where("copies > 1")
    others = texts.select("id", "key").join(copies, "key").where("id <> rep").select("id")
    single = texts.select("id", "sig").join(others, "id", "left_anti")
    found = Stage(links(single, texts, texts.count(), threshold, miss).distinct(), "links").df
    groups = connected_components(found).select(F.col("v").alias("rep"), F.col("root").alias("group_id"))
    placed = classes.join(groups, "rep", "left").where("copies > 1 or group_id is not null")
    members = texts.select("doc_hash", "key").join(placed, "key").select("doc_hash", "rep", F.hex("key").alias("class_key"), F.coalesce("group_id", "rep").alias("group_id"))
    if not count_links:
        return members.drop("rep")
    inside = Stage(groups, "groups").df
    pairs = inside.join(inside.select("group_id", F.col("rep").alias("b")), "group_id").where("rep < b").select(F.col("rep").alias("a"), "b")
    linked = verified(pairs, texts, threshold, miss)
    degree = linked.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select("doc_hash", "class_key", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def group_pairs(members: DataFrame, block: int = 2000) -> DataFrame:
    """``(hash_a, hash_b)`` for each two members of one group. A large group is cut into blocks by hash, and each two blocks
    meet in a task of their own."""
    m = Stage(members.select("doc_hash", "group_id"), "members").df
    sizes = m.groupBy("group_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = Stage(m.join(sizes, "group_id").withColumn("own", F.pmod(F.xxhash64("doc_hash"), F.col("blocks")).cast("int")), "blocks").df
    left = own.select("group_id", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("doc_hash").alias("x"))
    right = own.select("group_id", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("doc_hash").alias("y"))
    both = left.join(right, ["group_id", "i", "j"]).where("i < j and x <> y or x < y")
    return both.select(F.least("x", "y").alias("hash_a"), F.greatest("x", "y").alias("hash_b"))
