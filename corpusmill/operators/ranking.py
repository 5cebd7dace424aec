"""Ranked candidates: reranking, metrics and their comparison. A pool is one row per candidate with a position from 1;
ties in score keep the pool's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def rerank(pool: DataFrame, item: str, score: Column, position: str = "pos") -> DataFrame:
    """Candidates with their ``rank`` by score, best first; a null score sorts last, ties by position."""
    w = Window.partitionBy(item).orderBy(score.desc_nulls_last(), position)
    return pool.withColumn("rank", F.row_number().over(w))


def with_fallback(pool: DataFrame, item: str, score: str, position: str = "pos") -> DataFrame:
    """As ``rerank``; an item of which any candidate lacks a score keeps its own order."""
    whole = F.min(F.col(score).isNotNull()).over(Window.partitionBy(item))
    return rerank(pool.withColumn("fallback", ~whole), item, F.when(~F.col("fallback"), F.col(score)), position)


def gold_rank(ranked: DataFrame, item: str, correct: str = "correct", rank: str = "rank") -> DataFrame:
    """``(item, best, size)``: the best rank of a correct candidate, null if there is none, and the pool's size."""
    return ranked.groupBy(item).agg(F.min(F.when(F.col(correct), F.col(rank))).alias("best"), F.count("*").alias("size"))


def metrics(prefix: str = "", best: str = "best", ks: tuple[int, ...] = (1, 3, 5)) -> list[Column]:
    """Aggregates over items: cases, covered, hits at k, and the sum of reciprocal ranks as whole 1/27720 parts up to rank 12."""
    b = F.col(best)
    unit = F.when(b <= 12, F.floor(F.lit(27720) / b)).otherwise(0)
    return [F.count("*").alias(f"{prefix}cases"), F.count(b).alias(f"{prefix}covered"), *[F.count_if(b <= k).alias(f"{prefix}top{k}") for k in ks], F.sum(unit).cast("bigint").alias(f"{prefix}rr_units")]


def changes(before: DataFrame, after: DataFrame, item: str) -> DataFrame:
    """``(item, was, is)`` of items whose first place turned right or wrong."""
    b = before.select(item, F.coalesce(F.col("best") == 1, F.lit(False)).alias("was"))
    a = after.select(item, F.coalesce(F.col("best") == 1, F.lit(False)).alias("is"))
    return b.join(a, item).where(F.col("was") != F.col("is"))


def paired(before: DataFrame, after: DataFrame, item: str, *by: str) -> DataFrame:
    """Gains, losses and net of each group."""
    x = before.select(item, *by, F.coalesce(F.col("best") == 1, F.lit(False)).alias("was")).join(after.select(item, F.coalesce(F.col("best") == 1, F.lit(False)).alias("is")), item)
    gain, loss = F.count_if(F.col("is") & ~F.col("was")), F.count_if(F.col("was") & ~F.col("is"))
    return x.groupBy(*by).agg(F.count("*").alias("pairs"), gain.alias("gain"), loss.alias("loss"), (gain - loss).alias("net"))


def diverse_top(texts: Column, n: int, prefix: int) -> Column:
    """Of an ordered array the first ``n`` that share no start of ``prefix`` characters with one taken before."""
    start = lambda x: F.substring(x, 1, prefix)
    taken = F.aggregate(texts, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) < n) & ~F.exists(a, lambda y: start(y) == start(x)), F.concat(a, F.array(x))).otherwise(a))
    return taken


def keyword_in_context(docs: DataFrame, key: str, text: str, terms: list[str], width: int = 40) -> DataFrame:
    """``(key, term, at, left_, right_)``: every occurrence of each term without regard to case, at its place from 1, with
    ``width`` characters to both sides. Occurrences may overlap."""
    low = F.lower(F.col(text))
    rows = docs.select(key, F.col(text).alias("_t"), low.alias("_l"), F.explode(F.array(*[F.lit(x.lower()) for x in terms])).alias("term")).where(F.contains("_l", F.col("term")))
    spots = F.filter(F.sequence(F.lit(1), F.length("_l")), lambda i: F.substr(F.col("_l"), i, F.length("term")) == F.col("term"))
    lo = F.greatest(F.lit(1), F.col("at") - width)
    hits = rows.withColumn("at", F.explode(spots))
    return hits.select(key, "term", "at", F.substr("_t", lo, F.col("at") - lo).alias("left_"), F.substr("_t", F.col("at") + F.length("term"), F.lit(width)).alias("right_"))


def breakdown(errors: DataFrame, decisions: DataFrame, item: str, by: list[str], decision: str, values: list[str]) -> DataFrame:
    """Errors of each group with a column for each decision of people on them, and ``undecided``."""
    joined = errors.join(decisions.select(item, decision), item, "left")
    return joined.groupBy(*by).agg(F.count("*").alias("errors"), *[F.count_if(F.col(decision) == v).alias(v) for v in values], F.count_if(F.col(decision).isNull()).alias("undecided"))


def label_sensitivity(candidates: DataFrame, item: str, rank: str, text: str, right: str, like: str) -> DataFrame:
    """``(item, strict, lenient, added)``: the first right rank, the first if candidates ``like`` the right one count too, and how many such texts there are."""
    first = lambda c: F.min(F.when(F.col(c), F.col(rank)))
    return candidates.groupBy(item).agg(first(right).alias("strict"), first(like).alias("lenient"), F.count_distinct(F.when(F.col(like) & ~F.col(right), F.col(text))).alias("added"))


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(check, rows, failed)``; a check that gives null fails."""
    aggregates = [F.count("*").alias("_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]]
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in checks]), F.array(*[F.col(k) for k in checks]))
    return df.agg(*aggregates).select(F.explode(entries).alias("check", "failed"), F.col("_rows").alias("rows"))


def quarantined(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with ``quarantine``: the rule that holds, ``both`` if several do, ``clear`` if none does."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return df.withColumn("quarantine", F.when(F.size(hit) == 0, "clear").when(F.size(hit) == 1, hit[0]).otherwise("both"))


def error_class(choice: Column, gold: Column) -> Column:
    """``correct``; ``notation`` if the letters and digits agree but for case and punctuation, or the Han letters alone do and there are some;
    else ``semantic``. Null if either is null."""
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    han = lambda c: F.regexp_replace(c, r"[^\p{IsHan}]", "")
    near = (letters(choice) == letters(gold)) | ((han(choice) == han(gold)) & (han(choice) != ""))
    return F.when(choice == gold, "correct").when(near, "notation").when(choice.isNotNull() & gold.isNotNull(), "semantic")
