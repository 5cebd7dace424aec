"""Problem 6: filling fixed-capacity containers with items.

Mixture-controlled packing. Items wait in queues by source. Each placement goes to the source that is furthest behind
its share of all tokens (deficit round-robin) and has an item that fits; of its items the largest that fits is taken,
so large items open containers and small ones close them. An item is whole unless it is longer than the capacity; then
it is cut into pieces of the capacity and a rest, and the pieces are items.

Items are spread over shards of bounded size by hash. A shard places all its items, so its deficits at the end follow
from its token counts alone; running sums of these give every shard the deficits that the shards before it leave. So
deficits carry across windows and partitions, and shards still run side by side.

Without targets the share of a source is its part of all tokens and shards are drawn by hash. With targets, every source
feeds the shards at the rate of its target until it is used up, when the others go on in their proportions: an item
whose middle is the c-th token of its source comes at time c / target, and by that time W = sum of min(all of a source,
target * time) tokens are placed, which tells the shard. So all windows up to the first exhausted source have the mix
wanted, though each item is still placed once.

Defined cases: null texts, and texts of no tokens, are no items; a null capacity or one under 1 holds nothing and gives
no containers; whole repeated rows are one item, other rows of the same ``doc_id`` are items of their own; a null
source is the source ``unknown``; empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.llm.mixing import canonical
from corpusmill.operators.dedup import running_total
from corpusmill.runtime import Stage, comparable

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SHARD_ITEMS = 12_000
PACKED = "pack_id string, container bigint, doc_id bigint, source string, start bigint, tokens bigint"
#: Rows of pack sizes the driver reads; a longer table is refused, not cut.
MOST_SIZES = 10_000
#: Tasks at most; beyond so many shards a task packs several, one after the other.
MOST_TASKS = 20_000


@functools.lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches, path: str):
    import pyarrow as pa

    encode = _encoding(path).encode_ordinary
    for batch in batches:
        sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
        known: dict = {}
        sources = [known[s] if s in known else known.setdefault(s, canonical(s)) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sources, pa.string()), pa.array(sizes, pa.int64()), batch.column(3)], ["doc_id", "source", "tokens", "row"])


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens)`` of each distinct row with a text."""
    # Texts are not moved to find repeated rows: a hash of the whole row stands for them.
    rows = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text", F.xxhash64(*[F.col(f"`{c}`") for c in comparable(documents)]).alias("row"))
    counted = rows.mapInArrow(lambda b: _count(b, tokenizer), "doc_id bigint, source string, tokens bigint, row bigint")
    return counted.where("tokens > 0").distinct()


def pack_shard(items: list[tuple[int, int, int]], capacity: int, share: dict[int, float], behind: dict[int, float]):
    """Packs items ``(item, source, tokens)``; yields ``(container, item, start, tokens)``.

    ``share``: of each source its part of all tokens; ``behind``: its deficit at the start.
    """
    stacks: dict[int, dict[int, list]] = {}
    sizes: dict[int, int] = {}  # of each source a bit for each size that waits
    for item, source, tokens in sorted(items, reverse=True):
        own = stacks.setdefault(source, {})
        at = 0
        while at < tokens:
            n = min(capacity, tokens - at)
            own.setdefault(n, []).append((item, at, n))
            at += n
    for source, own in stacks.items():
        bits = bytearray(capacity // 8 + 1)
        for n in own:
            bits[n >> 3] |= 1 << (n & 7)
        sizes[source] = int.from_bytes(bits, "little")
    below = [0] * (capacity + 1)
    least = {s: (b & -b).bit_length() - 1 for s, b in sizes.items()}
    placed = dict.fromkeys(stacks, 0)
    total, container = 0, 0
    while sizes:
        room = capacity
        # The order of need within a container changes only by what the container takes.
        need = [(-(behind.get(s, 0.0) + share.get(s, 0.0) * total - placed[s]), s) for s in sizes]
        heapq.heapify(need)
        while need and room:
            lack, s = heapq.heappop(need)
            if s not in sizes or least[s] > room:
                continue
            if not below[room]:
                below[room] = (2 << room) - 1
            n = (sizes[s] & below[room]).bit_length() - 1
            stack = stacks[s][n]
            item, at, _ = stack.pop()
            if not stack:
                del stacks[s][n]
                sizes[s] ^= 1 << n
                if not sizes[s]:
                    del sizes[s]
                elif least[s] == n:
                    least[s] = (sizes[s] & -sizes[s]).bit_length() - 1
            yield container, item, at, n
            placed[s] += n
            total += n
            room -= n
            if s in sizes:
                heapq.heappush(need, (lack + n, s))
        container += 1


def _pack_shards(batches, sizes):
    """Packs each shard of the partition; a partition holds all items of its shards."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("shard", "doc_id", "source", "tokens", "row")], null_placement="at_start"))
    shards = table.column("shard").to_numpy()
    starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
    for start, stop in zip(starts, np.r_[starts[1:], len(shards)], strict=True):
        part = table.slice(start, stop - start).combine_chunks()
        source = part.column("source").combine_chunks().dictionary_encode().indices.to_numpy()
        share = dict(zip(source.tolist(), part.column("share").to_pylist(), strict=True))
        behind = dict(zip(source.tolist(), part.column("behind").to_pylist(), strict=True))
        items = list(zip(range(len(source)), source.tolist(), part.column("tokens").to_pylist(), strict=True))
        for pack_id, capacity in sizes:
            rows = np.array(list(pack_shard(items, capacity, share, behind)), np.int64).reshape(-1, 4)
            for at in range(0, len(rows), 50_000):
                r = rows[at : at + 50_000]
                taken = part.select(["doc_id", "source"]).take(pa.array(r[:, 1]))
                columns = [pa.array([pack_id] * len(r), pa.string()), pa.array((np.int64(shards[start]) << 32) | r[:, 0]), taken.column(0).combine_chunks(), taken.column(1).combine_chunks(), pa.array(r[:, 2]), pa.array(r[:, 3])]
                yield pa.RecordBatch.from_arrays(columns, ["pack_id", "container", "doc_id", "source", "start", "tokens"])


def _by_time(items: DataFrame, sources: DataFrame, whole: int, shards: int) -> DataFrame:
    """``items`` with the shard in which each comes when its source gives tokens at the rate of its share."""
    placed = running_total(items, "tokens", ["row", "doc_id", "tokens"], ["source"], "upto")
    timed = placed.join(sources, "source").withColumn("time", (F.col("upto") - F.col("tokens") / 2) / F.col("share"))
    ends = Window.orderBy("end", "source")  # one row for each source
    after = ends.rowsBetween(1, Window.unboundedFollowing)
    # Between two ends W grows with the shares of the sources that are left.
    laps = sources.withColumn("end", F.col("n") / F.col("share")).withColumns({"left": F.coalesce(F.sum("share").over(after), F.lit(0.0)), "done": F.sum("n").over(ends)})
    knots = laps.agg(F.array_sort(F.collect_list(F.struct("end", "left", "done"))).alias("knots"))
    last = F.try_element_at(F.filter("knots", lambda k: k["end"] <= F.col("time")), F.lit(-1))
    w = F.coalesce(last["done"] + last["left"] * F.col("time"), F.col("rate") * F.col("time"))
    rate = sources.agg(F.sum("share").alias("rate"))
    return timed.crossJoin(F.broadcast(knots.crossJoin(rate))).withColumn("shard", F.least(F.floor(w * shards / F.lit(whole)), F.lit(shards - 1)).cast("int")).select("doc_id", "source", "tokens", "row", "shard")


def pack(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str = TOKENIZER, shard_items: int = SHARD_ITEMS, targets: dict[str, float] | None = None) -> DataFrame:
    """``(pack_id, container, doc_id, source, start, tokens)``: for each capacity, which tokens of which text lie in which container.

    ``targets``: of sources, by canonical name, the shares of tokens wanted, in any unit; sources left out come last.
    Containers are numbered in the order in which they are to be read.
    """
    listed = pack_sizes.where("capacity >= 1").select("pack_id", "capacity").distinct().limit(MOST_SIZES + 1).collect()
    if len(listed) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} pack sizes")
    sizes = sorted((str(r[0]), int(r[1])) for r in listed)
    if not sizes:
        return documents.sparkSession.createDataFrame([], PACKED)
    items = Stage(token_counts(documents, tokenizer), "tokens")
    shards = max(1, -(-items.rows // shard_items))
    base = items.df
    totals = Stage(base.groupBy("source").agg(F.sum("tokens").alias("n")), "totals").df
    whole = totals.agg(F.sum("n")).first()[0] or 1
    if targets is None:
        sources = totals.withColumn("share", F.col("n") / whole)
        # By the whole row, so that a doc_id that many rows share is spread too.
        items = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "tokens", "row"), F.lit(shards)).cast("int"))
    else:
        unit = sum(targets.values())
        wanted = base.sparkSession.createDataFrame([(k, float(v) / unit) for k, v in targets.items() if v > 0], "source string, share double")
        sources = totals.join(wanted, "source", "left").withColumn("share", F.coalesce("share", F.lit(1e-9)))
        items = Stage(_by_time(base, sources, whole, shards), "timed").df
    sums = Stage(items.groupBy("shard", "source").agg(F.sum("tokens").alias("n")), "sums").df
    shard_sizes = sums.groupBy("shard").agg(F.sum("n").alias("all"))
    # Deficit a shard leaves: share * its tokens - the source's tokens in it; a source it lacks leaves share * its tokens.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    reach = shard_sizes.withColumn("all_before", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    own = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("own_before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(sources.select("source", "share"), "source").join(reach, "shard").select("shard", "source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("behind"))
    ready = items.join(carried, ["shard", "source"]).select("shard", "doc_id", "source", "tokens", "row", "share", "behind")
    # A task for each shard: packing is bound by time, not by bytes.
    tasks = min(shards, MOST_TASKS)
    return ready.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).mapInArrow(lambda b: _pack_shards(b, sizes), PACKED)


def mixture_report(packed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``(pack_id, source, target, share, first_half, worst)``: of each source its target, its share of all tokens, its share in the
    first half of the shards, and how far it is off in the shard that is off most among those."""
    spark = packed.sparkSession
    unit = sum(targets.values())
    wanted = spark.createDataFrame([(k, float(v) / unit) for k, v in targets.items()], "source string, target double")
    shard = Stage(packed.groupBy("pack_id", F.shiftright("container", 32).alias("shard"), "source").agg(F.sum("tokens").alias("n")), "shares").df
    sizes = shard.groupBy("pack_id", "shard").agg(F.sum("n").alias("all"))
    last = shard.groupBy("pack_id").agg((F.floor(F.max("shard") / 2)).alias("middle"))
    known = shard.select("pack_id").distinct().crossJoin(F.broadcast(wanted))  # one row for each target
    grid = sizes.join(known, "pack_id").join(shard, ["pack_id", "shard", "source"], "left").join(last, "pack_id").fillna({"n": 0})
    early = F.col("shard") <= F.col("middle")
    off = F.abs(F.col("n") / F.col("all") - F.col("target"))
    return grid.groupBy("pack_id", "source", "target").agg((F.sum("n") / F.sum("all")).alias("share"), (F.sum(F.when(early, F.col("n"))) / F.sum(F.when(early, F.col("all")))).alias("first_half"), F.max(F.when(early, off)).alias("worst"))


def tempered(documents: DataFrame, power: float = 0.5, tokenizer: str = TOKENIZER) -> dict[str, float]:
    """Targets in proportion to a power of each source's tokens, as multilingual mixes use; of at most ``MOST_SIZES`` sources."""
    rows = token_counts(documents, tokenizer).groupBy("source").agg(F.sum("tokens").alias("n")).limit(MOST_SIZES + 1).collect()
    if len(rows) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} sources")
    return {r["source"]: r["n"] ** power for r in rows}


def pack_report(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Of each capacity the containers, tokens, texts, cut texts and fill."""
    packed = pack(documents, pack_sizes, tokenizer)
    kinds = pack_sizes.where("capacity >= 1").select("pack_id", "capacity").distinct()
    sums = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_if(F.col("start") == 0).alias("texts")).groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.sum("texts").alias("texts"), F.max("tokens").alias("fullest"))
    return sums.join(kinds, "pack_id").select("pack_id", "capacity", "containers", "texts", "pieces", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
