"""Session-level helpers: reading tables, and writing intermediate stages where every executor can read them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []
_made: list[list[Stage]] = []  # of each ``finished`` under way the stages written in it


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        path = tempfile.mkdtemp(prefix="corpusmill-")
        _own_dirs.append(path)
        if len(_own_dirs) == 1:
            atexit.register(lambda: [shutil.rmtree(p, ignore_errors=True) for p in _own_dirs])
        path = f"file://{path}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A new file in any file system that Hadoop knows; an existing one is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


class Stage:
    """A DataFrame written as a table in the shared folder: its lineage is cut, and lost executors cost nothing.

    ``df`` reads the table; ``rows`` is its exact count, taken from the Parquet footers; ``drop()`` removes it
    once nothing lazy refers to it any more.
    """

    def __init__(self, df: DataFrame, name: str = "stage"):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        if _made:
            _made[-1].append(self)

    @property
    def rows(self) -> int:
        if not hasattr(self, "_rows"):
            self._rows = self.df.count()
        return self._rows

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finished(make: Callable[[], DataFrame], name: str = "finished") -> Stage:
    """Writes what ``make`` gives and drops the stages that were written on the way; nothing else may refer to them."""
    _made.append([])
    try:
        stage = Stage(make(), name)
    finally:
        spent = _made.pop()
    for other in spent:
        if other is not stage:
            other.drop()
    if _made:
        _made[-1].append(stage)
    return stage


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; elsewhere it must be shipped (``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def comparable(df: DataFrame) -> list[str]:
    """The columns that rows can be told apart by: all but maps and variants, which do not compare."""
    return [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
