"""Writers and what belongs to a written corpus: order, manifests, fingerprints, offsets."""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.operators.dedup import running_total
from corpusmill.runtime import write_bytes


def write_once(df: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Writes a new folder; an existing one is an error. Readers see it whole or not at all (the committer's ``_SUCCESS``)."""
    df.write.mode("errorifexists").format(form).options(**options).save(path)


def write_splits(df: DataFrame, path: str, order: str, split: str = "split", form: str = "json") -> None:
    """A folder for each split, rows in global order over its files."""
    df.repartitionByRange(split, order).sortWithinPartitions(split, order).write.mode("errorifexists").partitionBy(split).format(form).save(path)


def write_rolling(df: DataFrame, path: str, rows_per_file: int) -> None:
    """zstd Parquet in files of bounded rows."""
    df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """zstd Parquet clustered by the leading digits of a hash, one folder a bucket; needs no exchange when read by bucket."""
    df.withColumn("bucket", F.pmod(F.crc32(F.col(key)), F.lit(buckets))).repartition(buckets, "bucket").write.mode("errorifexists").option("compression", "zstd").partitionBy("bucket").parquet(path)


def merged_offsets(parts: DataFrame, part: str, pos: str, length: str) -> DataFrame:
    """Offsets of concatenated parts, in order of part and position: running sums by ranges, so that no task orders a whole part."""
    return running_total(parts, length, [part, pos], name="_upto").withColumn("offset", F.col("_upto") - F.col(length)).drop("_upto")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file below a folder, by its path from there. A file is read whole: for files of bounded size, as writers make them."""
    rest = F.substring_index("path", path.split("://", 1)[-1].rstrip("/") + "/", -1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(rest.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


#: Files that a manifest lists at most; more are refused.
MOST_FILES = 1_000_000


def manifest(config: dict, counts: dict, files: DataFrame) -> str:
    """A manifest as JSON with sorted keys; ``files`` is one row per written file, each of another name."""
    rows = files.select("file", "sha256").limit(MOST_FILES + 1).collect()
    listed = {r["file"]: r["sha256"] for r in rows}
    if len(rows) > MOST_FILES or len(listed) < len(rows):
        raise ValueError("manifest: too many files, or two of one name")
    return json.dumps({"config": config, "counts": counts, "files": listed}, sort_keys=True, ensure_ascii=False)


@contextmanager
def locked(spark: SparkSession, path: str):
    """Holds a lock file beside a folder; a second holder is refused. The file system makes it atomically or not at all."""
    lock = f"{path}.lock"
    try:
        write_bytes(spark, lock, b"")
    except Exception as e:
        raise RuntimeError(f"{path} is locked by another run") from e
    try:
        yield
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lock)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, False)


def write_resumable(parts: dict, path: str, form: str = "parquet") -> list[str]:
    """Writes each named part, a function that gives its DataFrame, into a folder of its own; parts that a run before finished
    are left as they are, unfinished ones are written anew. Gives the names written now; one run at a time."""
    done: list[str] = []
    for name, make in parts.items():
        df = make()
        spark = df.sparkSession
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        with locked(spark, f"{path}/{name}"):
            if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
                df.write.mode("overwrite").format(form).save(f"{path}/{name}")
                done.append(name)
    return done


def fingerprint(*parts: object) -> str:
    """A digest of a configuration that does not depend on key order or line ends."""
    whole = json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str).replace("\\r\\n", "\\n")
    return hashlib.sha256(whole.encode()).hexdigest()


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; one of more than ``most`` rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def uncached(requests: DataFrame, cache: DataFrame, key: str, policy: str) -> DataFrame:
    """Requests whose fingerprint under the policy the cache lacks."""
    of = lambda df: df.withColumn("request_hash", F.sha2(F.concat_ws("\0", F.lit(policy), F.col(key).cast("string")), 256))
    return of(requests).join(cache.select("request_hash"), "request_hash", "left_anti")
