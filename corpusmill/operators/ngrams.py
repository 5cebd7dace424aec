"""A character n-gram model with absolute discounts and back-off (Kneser-Ney): counted, stored and applied as tables.

The highest order counts grams inside documents; each lower order counts distinct left extensions. Characters that
occur less than ``MIN_COUNT`` times are one unknown sign, and a separator stands before every document and between turns.
Grams are collapsed in the map tasks before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions.fold import code_points
from corpusmill.functions.search import CountedModel
from corpusmill.runtime import Stage

ORDER, MIN_COUNT = 5, 2
UNKNOWN, SEPARATOR = "\x01", "\x02"
CHUNK = 2_000_000  # characters that a map task collapses at a time


@dataclass
class Model:
    """``grams``: (level, ctx, ch, n), written; ``contexts``: (level, ctx, total, kinds), a view of them; the discount of each level, the
    known characters and how many there are."""

    grams: DataFrame
    contexts: DataFrame
    discounts: dict[int, float]
    known: np.ndarray
    vocabulary: int
    order: int

    @property
    def spark(self) -> SparkSession:
        return self.grams.sparkSession


def _characters(batches):
    import pyarrow as pa

    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        points, _ = code_points([SEPARATOR + x for x in batch.column(0).to_pylist()])
        total += np.bincount(points, minlength=0x110000)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["c", "n"])


def _mapped(texts: list[str], known: np.ndarray):
    """Code points of all texts, unknown ones replaced, a separator before each; and the offsets."""
    points, offsets = code_points([SEPARATOR + (x or "") for x in texts])
    return np.where(known[points], points, ord(UNKNOWN)).astype(np.uint32), offsets


def _strings(points: np.ndarray, width: int) -> list[str]:
    whole = np.ascontiguousarray(points.astype(np.uint32)).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + width] for i in range(0, len(whole), width)]


def _grams(batches, known: np.ndarray, order: int):
    import pyarrow as pa

    def counted(texts):
        points, offsets = _mapped(texts, known)
        starts = np.arange(max(0, len(points) - order + 1))
        starts = starts[starts + order <= offsets[np.searchsorted(offsets, starts, side="right")]] if len(starts) else starts
        rows = np.stack([points[starts + j] for j in range(order)], 1) if len(starts) else np.zeros((0, order), np.uint32)
        high, low = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for j in range(order):  # 21 bits a character, three in each key
            if j < 3:
                high = (high << np.uint64(21)) | rows[:, j]
            else:
                low = (low << np.uint64(21)) | rows[:, j]
        perm = np.lexsort((low, high))
        low, high, rows = low[perm], high[perm], rows[perm]
        first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(rows) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(_strings(rows[first].ravel(), order), pa.string()), pa.array(np.diff(np.r_[first, len(rows)]).astype(np.int64))], ["g", "n"])

    held, size = [], 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(x)
            size += len(x or "")
            if size >= CHUNK:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def train(texts: DataFrame, text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """Counts a model of up to six characters a gram; null texts are left out. Documents of equal text count as often as they occur."""
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    rows = texts.where(F.col(text).isNotNull()).select(text)
    seen = rows.mapInArrow(_characters, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).toPandas()  # at most all of Unicode
    known = np.zeros(0x110000, bool)
    known[seen["c"].to_numpy(np.int64)] = True
    levels: dict[int, DataFrame] = {}
    highest = rows.mapInArrow(lambda b: _grams(b, known, order), "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    whole = None
    for level in range(order, 0, -1):
        counted = highest if level == order else levels[level + 1].groupBy(F.expr("right(ctx || ch, %d)" % level).alias("g")).agg(F.count("*").alias("n"))
        levels[level] = Stage(counted.select(F.lit(level).alias("level"), F.expr("left(g, %d)" % (level - 1)).alias("ctx"), F.expr("right(g, 1)").alias("ch"), "n"), f"grams{level}").df
        whole = levels[level] if whole is None else whole.unionByName(levels[level])
    ones = {r["level"]: (r["n1"], r["n2"]) for r in whole.groupBy("level").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
    discounts = {level: (lambda n1, n2: n1 / (n1 + 2 * n2) if n1 else 0.5)(*ones.get(level, (0, 0))) for level in range(1, order + 1)}
    contexts = whole.groupBy("level", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return Model(whole, contexts, discounts, known, int(known.sum()) + 1, order)


def summary(model: Model) -> DataFrame:
    """``(level, grams, contexts, total, discount)``."""
    sizes = model.contexts.groupBy("level").agg(F.sum("kinds").alias("grams"), F.count("*").alias("contexts"), F.sum("total").alias("total"))
    return sizes.withColumn("discount", F.element_at(F.create_map(*[F.lit(x) for k, v in model.discounts.items() for x in (k, v)]), F.col("level")))


def places(df: DataFrame, key: str, context: Column, text: Column, model: Model) -> DataFrame:
    """``(key, pos, hist, ch)``: each character of the text, unknown ones replaced, with the ``order - 1`` before it, those
    of the context and its separator among them."""
    kind, known, back = df.schema[key].dataType.simpleString(), model.known, model.order - 1

    def over(batches):
        import pyarrow as pa

        for batch in batches:
            names, contexts, texts = (batch.column(i).to_pylist() for i in range(3))
            points, offsets = _mapped([(c or "") + x for c, x in zip(contexts, texts, strict=True)], known)
            whole = points.tobytes().decode("utf-32-le", "surrogatepass")
            rows = [(name, i, whole[max(a, at - back) : at], whole[at]) for name, c, x, a, z in zip(names, contexts, texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for i, at in enumerate(range(z - len(x), z))]
            for n in range(0, len(rows), 50_000):
                part = list(zip(*rows[n : n + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], batch.schema.field(0).type), *(pa.array(p) for p in part[1:])], [key, "pos", "hist", "ch"])

    given = df.select(key, context.alias("_c"), text.alias("_x")).where("_x is not null")
    return given.mapInArrow(over, f"{key} {kind}, pos bigint, hist string, ch string")


def log_shares(asked: DataFrame, key: str, model: Model) -> DataFrame:
    """``(key, pos, logp)`` of rows of ``places``: discounted counts, backed off from each order to the one below it. An order whose context
    was never seen passes the lower one on. Distinct questions are looked up once."""
    distinct = Stage(asked.select("hist", "ch").distinct(), "asked").df
    levels = F.filter(F.sequence(F.lit(1), F.lit(model.order)), lambda n: n - 1 <= F.length("hist"))
    each = distinct.select("hist", "ch", F.explode(levels).alias("level")).withColumn("ctx", F.expr("right(hist, level - 1)"))
    # What is asked is small against the model: it selects the model's rows first, and those are joined back.
    each = Stage(each, "lookups").df
    contexts = each.select("level", "ctx").distinct()
    own = model.grams.join(contexts, ["level", "ctx"], "left_semi")
    totals = own.groupBy("level", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    grams = model.grams.join(each.select("level", "ctx", "ch"), ["level", "ctx", "ch"], "left_semi")
    found = each.join(grams, ["level", "ctx", "ch"], "left").join(totals, ["level", "ctx"], "left")
    by_level = F.map_from_entries(F.collect_list(F.struct("level", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "total", "kinds"))))
    got = found.groupBy("hist", "ch").agg(by_level.alias("m"))
    at = lambda n: F.col("m")[n]
    top = lambda n: F.greatest(at(n)["n"] - F.lit(model.discounts[n]), F.lit(0.0)) / at(n)["total"]
    p = F.lit(model.discounts[1]) * at(1)["kinds"] / at(1)["total"] / F.lit(model.vocabulary) + top(1)
    for n in range(2, model.order + 1):
        got = got.withColumn(f"_p{n - 1}", p)
        lower = F.col(f"_p{n - 1}")
        p = F.when(at(n)["total"].isNull(), lower).otherwise(lower * (F.lit(model.discounts[n]) * at(n)["kinds"] / at(n)["total"]) + top(n))
    shares = got.withColumn("logp", F.log(p)).select("hist", "ch", "logp")
    return asked.join(shares, ["hist", "ch"]).select(key, "pos", "logp")


def suffix_scores(candidates: DataFrame, key: str, context: str, candidate: str, model: Model) -> DataFrame:
    """``(key, candidate, scored, logp)``: candidates of a key compared by what follows their common prefix.

    Characters that all candidates of a key share at their start cancel out and are not scored; at least the last
    character of the shortest is. Equal candidates of a key count once; empty and null ones are left out.
    """
    rows = candidates.where(F.length(candidate) > 0).select(key, context, F.col(candidate).alias("candidate")).distinct()
    first, last, least = F.min("candidate"), F.max("candidate"), F.min(F.length("candidate"))
    ends = rows.groupBy(key).agg(first.alias("a"), last.alias("b"), (least - 1).alias("most"))  # what the first and the last share, all share
    shared = F.filter(F.when(F.col("most") > 0, F.sequence(F.lit(1), F.col("most"))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(F.col("a"), F.lit(1), i) == F.substr(F.col("b"), F.lit(1), i))
    named = F.concat_ws("\x1f", F.col(key).cast("string"), "candidate")
    keyed = Stage(rows.join(ends.select(key, F.size(shared).cast("bigint").alias("common")), key).withColumn("_k", named), "candidates").df
    asked = places(keyed, "_k", F.col(context), F.col("candidate"), model)
    scored = log_shares(asked, "_k", model).join(keyed.select(key, "candidate", "common", "_k"), "_k").where(F.col("pos") >= F.col("common"))
    return scored.groupBy(key, "candidate").agg(F.count("*").alias("scored"), F.sum("logp").alias("logp"))


def in_memory(model: Model, most: int = 2_000_000) -> CountedModel:
    """The model as a scorer for searches; one of more than ``most`` grams is refused."""
    rows = model.grams.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a model of more than {most} grams cannot be sent to the tasks")
    return CountedModel([tuple(r) for r in rows], model.discounts, map(chr, np.flatnonzero(model.known)))
