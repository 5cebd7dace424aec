"""Streams over event tables: resumable copies, committed cursors, quotas, and event-time windows (the last are our own
additions). Each run takes what has arrived and stops; state and progress live in the checkpoint folder."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusmill.operators.sequences import permuted
from corpusmill.runtime import write_bytes

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is, each batch written once under its number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of results written in update mode, the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")


def tumbling(events: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str, delay: str = "10 minutes") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return e.groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user: events closer than the gap. The same columns work on a stream with a watermark."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


def over_quota(events: DataFrame, seconds: int, requests: int) -> DataFrame:
    """Events with the number of the same user's events in the ``seconds`` up to them; ``admitted`` while that is within the quota."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("_us", micros).withColumn("recent", F.count("*").over(w)).withColumn("admitted", F.col("recent") <= requests).drop("_us")


def stateful(events: DataFrame, fold: Callable, output: str, state: str) -> DataFrame:
    """A custom operator with state for each user, for streams that no built-in aggregate fits."""
    return events.groupBy("user_id").applyInPandasWithState(fold, output, state, "update", "NoTimeout")


class Cursor:
    """The place of the next row of a store that is read in permuted epochs, committed in a folder that all runs share.

    ``take`` hands so many rows to ``consume`` and moves the cursor only after that has returned; a failure leaves it where it was.
    The tail of an epoch borrows what it lacks from the next, so no row is dropped or given twice within an epoch.
    """

    def __init__(self, store: DataFrame, key: str, folder: str, seed: int):
        self.store, self.key, self.folder, self.seed = store, key, folder, seed
        self.size = store.count()
        if not self.size:
            raise ValueError("an empty store")

    def _files(self):
        spark = self.store.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []

    @property
    def state(self) -> dict[str, int]:
        """``epoch`` and ``offset`` of the next row; each commit is a file of its own, and the last one counts."""
        names = [f for f in self._files() if f.startswith("commit-")]
        at = max((int(f.split("-")[1]) for f in names), default=0)
        return {"epoch": at // self.size, "offset": at % self.size}

    def take(self, n: int, consume: Callable[[DataFrame], object]) -> object:
        now = self.state
        first = now["epoch"] * self.size + now["offset"]
        rows = None
        for epoch in range(first // self.size, (first + n - 1) // self.size + 1):
            at = F.col("place") + F.lit(epoch * self.size)
            part = permuted(self.store, self.key, self.seed, epoch).select(self.key, F.lit(epoch).alias("epoch"), at.alias("at")).where(F.col("at").between(first, first + n - 1))
            rows = part if rows is None else rows.unionByName(part)
        result = consume(rows)
        write_bytes(self.store.sparkSession, f"{self.folder}/commit-{first + n:020d}", json.dumps({"from": first, "rows": n}).encode())
        return result


def dispatched(requests: DataFrame, order: list[str], accounts: int, each: int) -> DataFrame:
    """Requests with ``account`` and ``window``: dealt in order to the accounts in turn, ``each`` of them to an account in one window."""
    from corpusmill.operators.dedup import global_rank

    ranked = global_rank(requests, order)
    at = F.col("rank") - 1
    return ranked.select(*requests.columns, F.pmod(at, F.lit(accounts)).alias("account"), F.floor(at / (accounts * each)).alias("window"))


def retried(call: Callable[[], object], attempts: int = 5, wait: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, transient: tuple = (ConnectionError, TimeoutError)) -> object:
    """The result of a call that is tried again after transient errors, waiting twice as long each time; others pass at once."""
    for k in range(attempts):
        try:
            return call()
        except transient:
            if k + 1 == attempts:
                raise
            sleep(min(most, wait * 2**k))
    raise ValueError("no attempts")


def verified_generation(replies: DataFrame, checks: DataFrame, key: str, reply: str, schema: str, agree: list[str]) -> DataFrame:
    """Generated replies with an ``outcome``: ``unparsed``, ``incomplete`` (a field of ``agree`` is null), ``repeated`` (the same content under
    a smaller key), ``unverified`` (no blind check), ``refuted`` (the check differs in a field of ``agree``), or ``kept``.

    ``checks`` has the key and the fields as a second generator gave them without seeing the first.
    """
    parsed = replies.select(key, F.from_json(reply, schema).alias("r"))
    content = F.sha2(F.to_json(F.struct(*[F.col(f"r.{c}").alias(c) for c in agree])), 256)
    whole = F.lit(True)
    for c in agree:
        whole = whole & F.col(f"r.{c}").isNotNull()
    x = parsed.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("content", content)
    firsts = x.where("whole").groupBy("content").agg(F.min(key).alias("first"))
    told = checks.select(F.col(key).alias("_key"), F.struct(*agree).alias("c"))
    joined = x.join(firsts, "content", "left").join(told, F.col(key) == F.col("_key"), "left")
    same = F.lit(True)
    for c in agree:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    unparsed = F.col("r").isNull() | F.forall(F.array(*[F.col(f"r.{c}").isNull() for c in agree]), lambda v: v)
    outcome = F.when(unparsed, "unparsed").when(~F.col("whole"), "incomplete").when(F.col(key) != F.col("first"), "repeated").when(F.col("_key").isNull(), "unverified").when(~same, "refuted").otherwise("kept")
    return joined.select(key, F.col("r").alias("record"), outcome.alias("outcome"))
