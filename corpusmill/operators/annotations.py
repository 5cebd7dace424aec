"""Labels made by people: matching them to records, applying them, and refusing what does not fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The same rows; fails the query at the first row where the condition does not hold (null counts as failing)."""
    checked = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(checked)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fails if two rows have one key; gives the rows back."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(require(counted, F.col("_n") == 1, f"{', '.join(keys)}: not unique").drop("_n"), list(keys), "left_semi")


def apply_labels(records: DataFrame, labels: DataFrame, keys: list[str], text: str = "text", default: str = "keep") -> DataFrame:
    """Records with the ``action`` of their label, which must quote the record's text as ``snapshot``; the rest get ``default``."""
    joined = records.join(labels.select(*keys, "snapshot", F.col("action").alias("_action")), keys, "left")
    return require(joined, F.col("_action").isNull() | (F.col("snapshot") == F.col(text)), "a label quotes another text").select(*records.columns, F.coalesce("_action", F.lit(default)).alias("action"))


def match_fragments(fragments: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Each fragment with the number of records that match it on all keys."""
    counts = records.groupBy(*keys).agg(F.count("*").alias("matches"))
    return fragments.join(counts, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def unmatched(labels: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    return labels.join(records.select(*keys), keys, "left_anti")


def strata(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per record and stratum whose rule holds."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("stratum", F.explode(names))


def parsed_replies(replies: DataFrame, batch: str, reply: str, decisions: tuple[str, ...]) -> DataFrame:
    """``(batch, key, decision, error)`` of replies in JSON, ``{"decisions": [{"key": .., "decision": ..}]}``, read strictly: ``json`` for what
    does not parse or has other fields, ``empty`` for no decision, ``field`` for a null key, ``decision`` for an unknown one."""
    form = "decisions array<struct<key:string,decision:string>>, _bad string"
    x = replies.select(batch, F.from_json(reply, form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.json_object_keys(reply).alias("k"))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull() | (F.coalesce(F.array_join("k", ","), F.lit("")) != "decisions") | F.col("r.decisions").isNull()
    rows = x.select(batch, F.explode(F.when(broken | (F.size("r.decisions") == 0), F.array(F.lit(None).cast("struct<key:string,decision:string>"))).otherwise(F.col("r.decisions"))).alias("d"), broken.alias("broken"))
    error = F.when(F.col("broken"), "json").when(F.col("d").isNull(), "empty").when(F.col("d.key").isNull() | F.col("d.decision").isNull(), "field").when(~F.col("d.decision").isin(*decisions), "decision")
    return rows.select(batch, "d.key", "d.decision", error.alias("error"))


def reply_check(requests: DataFrame, replies: DataFrame, batch: str, key: str) -> DataFrame:
    """``(batch, accepted)``: batches whose replies name exactly the requested keys, each once and without an ``error``; nothing of a batch is
    accepted in part. Counted by key first, so that a large batch is no list."""
    bad = F.col("error").isNotNull() if "error" in replies.columns else F.lit(False)
    told = replies.groupBy(F.col(batch).alias("_batch"), F.col(key).cast("string").alias("_key")).agg(F.count("*").alias("_n"), F.bool_or(bad).alias("_bad"))
    asked = requests.select(F.col(batch).alias("_batch"), F.col(key).cast("string").alias("_key"), F.lit(True).alias("_asked")).distinct()
    both = asked.join(told, ["_batch", "_key"], "full_outer")
    fits = F.coalesce(F.col("_asked") & (F.col("_n") == 1) & ~F.col("_bad"), F.lit(False))
    return both.groupBy(F.col("_batch").alias(batch)).agg(F.bool_and(fits).alias("accepted"), F.bool_or(F.col("_asked").isNotNull()).alias("_known")).where("_known").drop("_known")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def agreement(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, left, right, verdict)`` of two dictionaries: ``agree``, ``differ``, ``only left`` or ``only right``. Keys must be unique."""
    a = left.select(key, F.col(value).alias("left"), F.lit(True).alias("_l"))
    b = right.select(key, F.col(value).alias("right"), F.lit(True).alias("_r"))
    verdict = F.when(F.col("_l").isNull(), "only right").when(F.col("_r").isNull(), "only left").when(F.col("left") == F.col("right"), "agree").otherwise("differ")
    return a.join(b, key, "full_outer").select(key, "left", "right", verdict.alias("verdict"))
