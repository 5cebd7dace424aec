"""Token sequences: windows, labels, padding, batches, and mixtures of stores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.operators.dedup import global_rank


def windows(sequences: DataFrame, context: int, tokens: str = "tokens", least: int = 2) -> DataFrame:
    """Non-overlapping windows ``(…, window_no, start, len)`` of a sequence: every pair of neighbours is predicted once.

    A window has up to ``context`` predictions and so ``context + 1`` tokens; the last token of one is the first of the next.
    """
    n = F.size(tokens)
    w = F.explode(F.sequence(F.lit(0), F.floor((n - 2) / context).cast("int"))).alias("window_no")
    out = sequences.where(n >= least).select("*", w)
    return out.withColumn("start", F.col("window_no") * context).withColumn("len", F.least(F.lit(context + 1), n - F.col("start")))


def shifted(tokens: Column, skip: int) -> tuple[Column, Column]:
    """Inputs and labels of a sequence; the first ``skip`` labels are masked by -100."""
    m = F.greatest(F.lit(0), F.size(tokens) - 1)
    k = F.least(F.lit(skip), m)
    return F.slice(tokens, 1, m), F.concat(F.array_repeat(F.lit(-100), k), F.slice(tokens, k + 2, F.greatest(F.lit(0), m - k)))


def padded(tokens: Column, multiple: int, pad: int = 0) -> Column:
    fill = F.pmod(-F.size(tokens), F.lit(multiple))
    return F.concat(tokens, F.array_repeat(F.lit(pad), fill))


def length_batches(sequences: DataFrame, key: str, length: Column, size: int, pool: int, seed: int) -> DataFrame:
    """Batches of like lengths: rows are dealt to pools by hash, a pool is sorted by length and cut, batches are shuffled by hash.

    Columns ``pool``, ``batch`` and ``turn``; a pool holds about ``pool`` rows and is the largest group of a task.
    """
    pools = F.greatest(F.lit(1), F.ceil(F.col("_n") / pool)).cast("bigint")
    total = sequences.agg(F.count("*").alias("_n"))
    dealt = sequences.withColumn("_l", length).crossJoin(F.broadcast(total)).withColumn("pool", F.pmod(F.xxhash64(F.lit(seed), key), pools)).drop("_n")
    r = F.row_number().over(Window.partitionBy("pool").orderBy("_l", key)) - 1
    return dealt.withColumn("batch", F.floor(r / size)).withColumn("turn", F.xxhash64(F.lit(seed), "pool", "batch")).drop("_l")


def block_shuffle(df: DataFrame, key: str, block: int, seed: int) -> DataFrame:
    """A global order by hash of the block, then by hash of the row."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.floor(F.col(key) / block)), F.xxhash64(F.lit(seed), key), key)


def splitmix(values: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 numbers of 64-bit indices."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def packing_cost(lengths: list[int], capacity: int, pass_cost: int) -> list[int]:
    """Cuts of lengths in descending order into passes of least cost: padding to the longest of a pass plus ``pass_cost`` each.

    Gives the ends of the passes. Each pass holds at most ``capacity`` padded tokens. Dynamic program over the cuts.
    """
    n = len(lengths)
    best, cut = [0] + [1 << 60] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        used = 0
        for start in range(end - 1, -1, -1):
            used += lengths[start]
            wide = lengths[start] * (end - start)
            if wide > capacity and end - start > 1:
                break
            cost = best[start] + wide - used + pass_cost
            if cost < best[end]:
                best[end], cut[end] = cost, start
    ends, at = [], n
    while at:
        ends.append(at)
        at = cut[at]
    return ends[::-1]


def epoch_map(always: DataFrame, cycled: DataFrame, key: str, size: str, fraction: float, epoch: int, seed: int) -> DataFrame:
    """One epoch of a mixture: all of ``always``, and of ``cycled`` in hash-permuted cycles as much as makes ``fraction`` of the whole.

    The cursor runs on over epochs: epoch e takes positions [e q, (e + 1) q) of the endless cycle. Sizes are summed over
    hash buckets first, so no task orders all rows.
    """
    whole = always.agg(F.sum(size)).first()[0] or 0
    quota = round(whole * fraction / (1 - fraction))
    h = F.xxhash64(F.lit(seed), key)
    c = cycled.select(key, size, h.alias("h")).withColumn("b", F.shiftrightunsigned("h", 56))
    per = c.groupBy("b").agg(F.sum(size).alias("n"))
    base = per.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # 256 rows
    length = cycled.agg(F.sum(size)).first()[0] or 0
    run = F.sum(size).over(Window.partitionBy("b").orderBy("h", key).rowsBetween(Window.unboundedPreceding, 0))
    placed = c.withColumn("run", run).join(F.broadcast(base), "b").withColumn("end", F.col("base") + F.col("run"))
    first, last = quota * epoch, quota * (epoch + 1)
    if not length or not quota:
        taken = placed.limit(0).withColumn("cycle", F.lit(0))
    else:
        taken = placed.withColumn("cycle", F.explode(F.sequence(F.lit(first // length), F.lit(last // length))))
        taken = taken.where((F.col("end") + F.col("cycle") * length > first) & (F.col("end") + F.col("cycle") * length <= last))
    return always.select(key, size, F.lit(-1).alias("cycle")).unionByName(taken.select(key, size, F.col("cycle").cast("int").alias("cycle")))


def batches_from(batched: DataFrame, start: int) -> DataFrame:
    """Batches of ``length_batches`` with ``number``, their place in the shuffled order from 0; those before the committed cursor
    ``start`` are left out. Numbers do not depend on where a run began."""
    each = batched.select("pool", "batch", "turn").distinct()
    numbered = global_rank(each, ["turn", "pool", "batch"]).select("pool", "batch", (F.col("rank") - 1).alias("number"))
    return batched.join(numbered.where(F.col("number") >= start), ["pool", "batch"])


def permuted(store: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """``(key, place)``: the store in the order of an epoch, by hash, from 0."""
    hashed = store.select(key).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")), 256))
    return global_rank(hashed, ["_h", key]).select(key, (F.col("rank") - 1).alias("place"))


def step_rows(stores: dict[str, tuple[DataFrame, int]], key: str, first: int, last: int, seed: int) -> DataFrame:
    """``(task, step, slot, key)`` of the steps from ``first`` up to ``last``: of each store so many rows a step, its epochs in permuted
    orders one after the other. What a step holds follows from its number alone, so a run can begin anywhere."""
    out = None
    for task, (store, count) in stores.items():
        n = store.count()
        if not n or not count:
            continue
        for epoch in range(first * count // n, max(first * count // n, (last * count - 1) // n) + 1):
            at = F.col("place") + F.lit(epoch * n)
            rows = permuted(store, key, seed, epoch).select(F.lit(task).alias("task"), F.floor(at / count).alias("step"), F.pmod(at, F.lit(count)).alias("slot"), key).where(F.col("step").between(first, last - 1))
            out = rows if out is None else out.unionByName(rows)
    return out


def schedule(step: Column, warmup: int, total: int, floor: float = 0.0, milestones: dict[int, float] | None = None) -> Column:
    """The rate of a step: a linear rise over ``warmup`` steps, then half a cosine down to ``floor`` at ``total``; from each
    milestone on it is multiplied by the milestone's factor."""
    part = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    rate = F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.pi() * part)))
    for at, factor in sorted((milestones or {}).items()):
        rate = rate * F.when(step >= at, F.lit(factor)).otherwise(F.lit(1.0))
    return rate


def record(context: Column, keys: Column, out: Column, budget: int, start: int, end: int, ctx: int, read: int, write: int) -> Column:
    """``start ctx context read keys write out end`` with the context cut from the left so that ``budget`` ids hold it; null where keys
    and output alone do not fit."""
    fixed = F.size(keys) + F.size(out) + 5
    room = F.greatest(F.lit(0), F.lit(budget) - fixed)
    kept = F.slice(context, F.greatest(F.lit(1), F.size(context) - room + 1), room)
    one = lambda i: F.array(F.lit(i))
    return F.when(fixed <= budget, F.concat(F.array(F.lit(start), F.lit(ctx)), kept, one(read), keys, one(write), out, one(end)))
