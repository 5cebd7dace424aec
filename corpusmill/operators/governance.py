"""Guards of held-out data: paths, gates, ledgers, signatures. All run on the driver over a few rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.operators.annotations import require
from corpusmill.sources.sinks import fingerprint

_HELD_OUT = re.compile(r"(?:^|[/_.\-])(?:blind|test|held[-_]?out)(?:[/_.\-]|$)", re.I)


def training_path(path: str) -> str:
    """The path; one that names held-out data is an error."""
    if _HELD_OUT.search(path):
        raise PermissionError(f"held-out data cannot be trained on: {path}")
    return path


def blind_gate(items: DataFrame, plan: dict, committed: str) -> DataFrame:
    """Items of a blind set, only if all are reviewed and the plan is the one committed before."""
    if fingerprint(plan) != committed:
        raise PermissionError("the plan is not the committed one")
    return require(items, F.col("reviewed"), "a blind item was not reviewed")


def consume_once(spark: SparkSession, ledger: str, name: str, signature: str) -> None:
    """Enters a use of a blind set into an append-only ledger; a second use with another signature is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(ledger)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        used = spark.read.schema("name string, signature string").json(ledger).where(F.col("name") == name).select("signature").distinct().limit(2).collect()
        if any(r[0] != signature for r in used):
            raise PermissionError(f"{name} was used already")
        if used:
            return
    spark.createDataFrame([(name, signature)], "name string, signature string").coalesce(1).write.mode("append").json(ledger)
