"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast at most; they are counted first.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a session in one JVM (local
    tests) takes a temporary folder; on a cluster this raises, as executors would
    not see the same one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pathglass-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, which ends its lineage there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathglass/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: dict = {}


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of every file at ``path``, a file or a folder."""
    at, fs = _hadoop(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def stored(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], sources: list[str]) -> DataFrame:
    """``make()`` as a table in the shared folder, as a store holds its tables.

    It is written once for each application and key, and anew when a file of its
    ``sources`` has changed or the table itself has gone; what it replaces is deleted.
    """
    slot = (spark.sparkContext.applicationId, shared_dir(spark), *key)
    now = [fingerprint(spark, s) for s in sources]
    seen, path, schema = _STORED.get(slot, (None, None, None))
    if path is not None:
        at, fs = _hadoop(spark, path)
        whole = fs.exists(at.suffix("/_SUCCESS"))
        if seen == now and whole:
            return spark.read.schema(schema).parquet(path)
        fs.delete(at, True)
    df, path = make(), f"{shared_dir(spark)}/pathglass/{key[0]}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED[slot] = (now, path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows; it is counted, so it should be a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
