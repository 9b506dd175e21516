"""Shared helpers: where intermediate tables live and how they are read back."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglass.storage import shared_dir


def new_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no earlier call has returned."""
    return f"{shared_dir(spark)}/pathglass/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are deleted once an operator's result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n, self.paths = spark, new_path(spark, "scratch"), 0, {}

    def table(self, df: DataFrame, what: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{what}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self._delete(self.paths.pop(id(table))[1])

    def _delete(self, name: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def result(self, df: DataFrame, what: str) -> DataFrame:
        """``df`` written to a folder of its own; the scratch tables go."""
        out = materialise(df, what)
        self._delete(self.path)
        return out


#: Keys that are broadcast at most because very many rows share them.
HOT_KEYS = 100_000


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int, how: str = "inner", least: int = 1_000) -> DataFrame:
    """``rows`` joined with ``keyed``, a written table of one row a key, without a hot group.

    ``size`` names the column of ``keyed`` that says how many of the ``total`` rows
    a key meets. Keys of at least ``least`` rows and of at least one in HOT_KEYS of all,
    of which there are HOT_KEYS at most, are broadcast; the other rows are shuffled.
    A table of at most HOT_KEYS keys is broadcast as it is.
    """
    if keyed.count() <= HOT_KEYS:
        return rows.join(F.broadcast(keyed), key, how)
    hot = keyed.filter(F.col(size) >= max(least, total // HOT_KEYS))
    near = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return near.unionByName(others.join(keyed.join(F.broadcast(hot.select(key)), key, "left_anti"), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Python workers outlive tasks; what an operator's tables hold is let go when another one's task starts.
_tables: dict = {"owner": None, "release": []}


def give_back() -> None:
    """Return freed memory to the system: a Python worker shares its executor's limit with the JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def release_with(owner: str, release) -> None:
    """Call ``release`` before tasks of other owners run in this worker."""
    if _tables["owner"] == owner and release not in _tables["release"]:
        _tables["release"].append(release)


@contextlib.contextmanager
def task_tables(owner: str):
    """Inside a task that fills large tables of small tuples.

    Frees the tables of other operators first, and lets the cyclic collector pass
    over the own ones less often.
    """
    if _tables["owner"] != owner:
        for release in _tables["release"]:
            release()
        _tables.update(owner=owner, release=[])
        gc.collect()
    give_back()
    before = gc.get_threshold()
    gc.set_threshold(100_000, 50, 1000)
    try:
        yield
    finally:
        gc.set_threshold(*before)
        give_back()


def text_stream(batch, name: str):
    """The texts of an Arrow batch one by one; null becomes the empty text."""
    for x in batch.column(name):
        yield x.as_py() or ""
