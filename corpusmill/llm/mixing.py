"""Problem 4: mixing sources to target weights.

Hierarchical budgeting: the target shares are summed up a tree of pool, family (the part of a source before the colon)
and source. A budget then goes down the tree by weight; what a source cannot take, because it is repeated at most
``max_repeat`` times, goes to its siblings first and to the families and pools above them only if these are full too.
Each source then gives whole epochs and, of one more, the prefix in a seeded order that its budget covers. Prefix sums
run over hash buckets first, so a source that holds a third of all rows is never in one task.

Sizes are ``pairs``. Only train rows count, each distinct row once; pools and sources compare by NFKC, trimmed, in
lower case. Without ``total`` the mix is as large as it can be with every source that has rows reaching its share: the
smallest ``max_repeat * size / share``; the shares of sources without rows go to their siblings.

Defined cases: rows with null or non-positive size give nothing; sources without target are left out; null sources
are the source ``unknown``; repeated targets of one source add up, with their smallest cap; a null or negative share
counts as 0, a null cap as 1; no targets or no rows give an empty mix.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.runtime import Stage

#: Rows of targets worked on by the driver; a larger table is refused, not cut.
MOST_TARGETS = 100_000
BUCKETS = 1024


def canonical(name: str | None) -> str:
    return unicodedata.normalize("NFKC", name or "").strip().lower() or "unknown"


def _canonical_batches(batches):
    import pyarrow as pa

    for batch in batches:
        known: dict = {}
        of = lambda x, known=known: known[x] if x in known else known.setdefault(x, canonical(x))
        columns = [pa.array([of(x) for x in batch.column(i).to_pylist()], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], batch.schema.names)


def train_rows(docs: DataFrame) -> DataFrame:
    rows = docs.where("lower(trim(split)) = 'train'").select("pool", "source", F.col("id").cast("string").alias("id"), F.col("priority").cast("bigint").alias("priority"), F.col("pairs").cast("bigint").alias("pairs")).distinct()
    return rows.where("pairs > 0").mapInArrow(_canonical_batches, "pool string, source string, id string, priority bigint, pairs bigint")


def fill(amount: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares ``amount`` by weight among children ``(weight, room)``; what one cannot take goes to the others."""
    given = [0.0] * len(children)
    open_ = [i for i, (w, room) in enumerate(children) if w > 0 and room > 0]
    while open_ and amount > 1e-9:
        total = sum(children[i][0] for i in open_)
        level = {i: amount * children[i][0] / total for i in open_}
        full = [i for i in open_ if given[i] + level[i] >= children[i][1]]
        if not full:
            for i in open_:
                given[i] += level[i]
            return given
        for i in full:
            amount -= children[i][1] - given[i]
            given[i] = children[i][1]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budgets(leaves: list[dict], total: float | None = None) -> list[dict]:
    """Adds ``wanted`` and ``budget`` to leaves of pool, source, share, max_repeat and size."""
    scale = sum(x["share"] for x in leaves) or 1.0
    for x in leaves:
        x["share"] /= scale
        x["room"] = x["max_repeat"] * x["size"]
    if total is None:
        total = min((x["room"] / x["share"] for x in leaves if x["room"] > 0 and x["share"] > 0), default=0.0)
    # A total that every present source can serve leaves room for what absent ones do not take.
    tree: dict[str, dict[str, list[dict]]] = {}
    for x in leaves:
        x["wanted"] = total * x["share"]
        tree.setdefault(x["pool"], {}).setdefault(x["source"].split(":")[0] if ":" in x["source"] else "", []).append(x)
    weigh = lambda xs: (sum(x["share"] for x in xs), sum(x["room"] for x in xs if x["share"] > 0))
    pools = list(tree.values())
    for pool, a in zip(pools, fill(total, [weigh([x for f in p.values() for x in f]) for p in pools]), strict=True):
        families = list(pool.values())
        for family, b in zip(families, fill(a, [weigh(f) for f in families]), strict=True):
            for x, c in zip(family, fill(b, [weigh([x]) for x in family]), strict=True):
                x["budget"] = c
    return leaves


def _plan(rows: DataFrame, targets: DataFrame, total: float | None) -> list[dict]:
    listed = targets.limit(MOST_TARGETS + 1).collect()
    if len(listed) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    leaves: dict[tuple, dict] = {}
    for r in listed:
        cap = 1 if r["max_repeat"] is None else max(0, int(r["max_repeat"]))
        share = r["target_share"] if r["target_share"] is not None and r["target_share"] > 0 else 0.0
        x = leaves.setdefault((canonical(r["pool"]), canonical(r["source"])), {"share": 0.0, "max_repeat": cap})
        x["share"] += share
        x["max_repeat"] = min(x["max_repeat"], cap)
    spark = rows.sparkSession
    keys = spark.createDataFrame(list(leaves) or [("", "")], "pool string, source string")
    sizes = {(r["pool"], r["source"]): r["size"] for r in rows.join(keys, ["pool", "source"], "left_semi").groupBy("pool", "source").agg(F.sum("pairs").alias("size")).collect()}  # one row for each target at most
    return budgets([{"pool": p, "source": s, "size": sizes.get((p, s), 0)} | x for (p, s), x in leaves.items()], total)


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> DataFrame:
    """``(pool, source, id, epoch, pairs)``: the rows of the mix; a row occurs once for each epoch that takes it."""
    rows = Stage(train_rows(docs), "mix").df
    return _take(rows, _plan(rows, targets, total), seed)


def _take(rows: DataFrame, plan: list[dict], seed: int) -> DataFrame:
    spark = rows.sparkSession
    limits = []
    for x in plan:
        whole = min(x["max_repeat"], math.floor(x["budget"] / x["size"] + 1e-9)) if x["size"] else 0
        limits.append((x["pool"], x["source"], whole, max(0, math.floor(x["budget"] - whole * x["size"] + 1e-6)) if whole < x["max_repeat"] else 0))
    quota = spark.createDataFrame(limits or [("", "", 0, 0)], "pool string, source string, whole int, part bigint")
    h = F.xxhash64(F.lit(seed), F.col("whole"), "pool", "source", "priority", "id", "pairs")
    placed = rows.join(quota, ["pool", "source"]).withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 54))
    sums = placed.groupBy("pool", "source", "bucket").agg(F.sum("pairs").alias("n"))
    before = Window.partitionBy("pool", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    here = Window.partitionBy("pool", "source", "bucket").orderBy("h", "priority", "id", "pairs").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(base, ["pool", "source", "bucket"]).withColumn("until", F.col("base") + F.sum("pairs").over(here))
    epochs = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>")), F.when(F.col("until") <= F.col("part"), F.array("whole")).otherwise(F.array().cast("array<int>")))
    return ranked.select("pool", "source", "id", F.explode(epochs).alias("epoch"), "pairs")


def shares(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> DataFrame:
    """Of each target its share and budget, what the mix took of it, how often, and the shortfall against the wanted size."""
    rows = Stage(train_rows(docs), "mix").df
    plan = _plan(rows, targets, total)
    taken = _take(rows, plan, seed).groupBy("pool", "source").agg(F.sum("pairs").alias("pairs"), F.max(F.col("epoch") + 1).alias("repeats"))
    asked = rows.sparkSession.createDataFrame([(x["pool"], x["source"], x["share"], x["max_repeat"], x["size"], round(x["wanted"]), round(x["budget"])) for x in plan], "pool string, source string, target_share double, max_repeat int, available bigint, wanted bigint, budget bigint")
    everything = Window.partitionBy()  # one row for each target
    out = asked.join(taken, ["pool", "source"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0))).withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    return out.withColumn("share", F.col("pairs") / F.greatest(F.sum("pairs").over(everything), F.lit(1))).withColumn("shortfall", F.greatest(F.col("wanted") - F.col("pairs"), F.lit(0)))
