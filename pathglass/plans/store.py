"""A store of analyses: a folder of tables each, complete once its manifest is there."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglass.errors import TraceError, invalid, not_found
from pathglass.schemas import TABLES


class Store:
    """``root/<analysis>/<table>`` as Parquet and ``root/<analysis>/manifest`` as JSON.

    An analysis is written to a staging folder of its own, its manifest last, and then
    renamed, so a reader sees all of it or none and two writers never mix; ``sweep``
    clears away what failed writers have left.
    """

    #: Where analyses are written before they are renamed; no analysis has such a name.
    STAGING = ".staging-"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, analysis: str, tables: dict[str, DataFrame], manifest: dict) -> None:
        """Write an analysis whole; the second of two writers of one id fails."""
        if not analysis or "/" in analysis or "\0" in analysis or analysis.startswith("."):
            raise invalid(f"not an analysis id: {analysis!r}")
        fs, staging = self._fs(), f"{self.STAGING}{analysis}-{uuid.uuid4().hex}"
        if fs.exists(self._path(analysis)):
            raise invalid(f"{analysis} exists", "publish under a new id")
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{staging}/{name}")
        # A single row; it names what a reader may expect.
        row = json.dumps(manifest | {"id": analysis, "tables": sorted(tables)}, sort_keys=True)
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.text(f"{self.root}/{staging}/manifest")
        # Renaming onto a folder that another writer has made meanwhile would move into it.
        if fs.exists(self._path(analysis)) or not fs.rename(self._path(staging), self._path(analysis)):
            fs.delete(self._path(staging), True)
            raise invalid(f"{analysis} exists", "publish under a new id")
        if fs.exists(self._path(analysis, staging)):
            fs.delete(self._path(analysis, staging), True)
            raise invalid(f"{analysis} exists", "publish under a new id")

    def import_analysis(self, folder: str, names: list[str], manifest: dict, budget_bytes: int | None = None) -> bool:
        """Copy the tables of a bundle, Parquet folders below ``folder``, under the id of its manifest (SRC16).

        Names must stay inside the bundle. False if the id is here already, so that an
        import can be repeated.
        """
        for name in names:
            if not name or name.startswith("/") or ".." in name.split("/") or "\0" in name:
                raise invalid(f"a path leaves the bundle: {name!r}")
        if not manifest.get("id"):
            raise invalid("the manifest has no id")
        if self._fs().exists(self._path(manifest["id"])):
            return False
        if budget_bytes is not None:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            size = sum((p := hadoop(f"{folder}/{n}")).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for n in names)
            if size > budget_bytes:
                raise TraceError("LIMIT_EXCEEDED", f"the bundle has {size} bytes")
        self.publish(manifest["id"], {n: self.spark.read.parquet(f"{folder}/{n}") for n in names}, manifest)
        return True

    def manifest(self, analysis: str) -> dict:
        if not self._fs().exists(self._path(analysis, "manifest")):
            raise not_found(f"no analysis {analysis}")
        return json.loads(self.spark.read.text(f"{self.root}/{analysis}/manifest").first()["value"])

    def read(self, analysis: str, name: str) -> DataFrame:
        """A table; one that the analysis lacks is empty with its usual schema."""
        if name in self.manifest(analysis)["tables"]:
            return self.spark.read.parquet(f"{self.root}/{analysis}/{name}")
        if name not in TABLES:
            raise not_found(f"no table {name} in {analysis}")
        return self.spark.createDataFrame([], TABLES[name])

    def catalog(self) -> list[dict]:
        """The manifests, latest first."""
        fs, root = self._fs(), self._path()
        if not fs.exists(root):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith(".") and fs.exists(self._path(s.getPath().getName(), "manifest"))]
        return [self.manifest(name) for _, name in sorted(found, reverse=True)]

    def default_analysis(self) -> dict:
        """Of the call analyses the one with the newest format, then full detail, then the latest."""
        calls = [m for m in self.catalog() if m.get("detail", "calls") == "calls"]
        if not calls:
            raise not_found("no analysis", "decode a snapshot first")
        return max(calls, key=lambda m: (m.get("ir_version", 0), m.get("decode_mode") == "full"))

    def find_cached(self, key: str) -> dict | None:
        """An analysis that was published under this cache key."""
        return next((m for m in self.catalog() if m.get("cache_key") == key), None)

    def sizes(self) -> DataFrame:
        """(analysis, bytes), largest first."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        name = F.element_at(F.split(F.substring_index("path", f"{self.root.split(':', 1)[-1].lstrip('/')}/", -1), "/"), 1)
        return files.select(name.alias("analysis"), F.col("length")).groupBy("analysis").agg(F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), "analysis")

    def sweep(self, older_than_s: float = 86_400) -> list[str]:
        """Delete folders without a manifest and staging folders that are older; returns their names.

        A staging folder is as old as the newest change inside, so one in use stays.
        """
        fs, gone = self._fs(), []
        for s in fs.listStatus(self._path()):
            name = s.getPath().getName()
            whole = not name.startswith(self.STAGING) and fs.exists(self._path(name, "manifest"))
            newest = max([s.getModificationTime(), *(x.getModificationTime() for x in fs.listStatus(s.getPath()))]) if s.isDirectory() else 0
            if s.isDirectory() and not whole and newest <= (time.time() - older_than_s) * 1000:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def prune(self, budget_bytes: int, keep: tuple[str, ...] = ()) -> list[str]:
        """Delete the oldest analyses until the store fits; those to keep stay."""
        sizes = {r["analysis"]: r["bytes"] for r in self.sizes().collect()}
        total, gone = sum(sizes.values()), []
        for m in reversed(self.catalog()):
            if total <= budget_bytes:
                break
            if m["id"] not in keep:
                self._fs().delete(self._path(m["id"]), True)
                total -= sizes.get(m["id"], 0)
                gone.append(m["id"])
        return gone


def write_jsonl(df: DataFrame, path: str) -> None:
    """A table as JSON lines, a line for each row, nulls left out (SNK1); a folder, whole or absent."""
    df.write.option("ignoreNullFields", "true").json(path)


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON document (SRC2): NOT_FOUND if there is none, DECODE_FAILED if it is not JSON."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise not_found(f"no document {path}")
    try:
        return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    except json.JSONDecodeError as e:
        raise TraceError("DECODE_FAILED", f"not JSON: {path}: {e.msg}") from e


def sessions_page(sessions: DataFrame, cursor: str | None = None, limit: int = 50) -> dict:
    """A page of sessions (LIM3): a cursor that is no number begins anew, more follows if the page is full."""
    limit = max(1, min(int(limit), 200))
    at = int(cursor) if cursor is not None and cursor.isdigit() else 0
    rows = [r.asDict(recursive=True) for r in sessions.orderBy("id").offset(at).limit(limit).collect()]
    return {"data": rows, "next_cursor": str(at + limit) if len(rows) == limit else None}


def archive_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder of images (SRC18)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def harvest(mappings: DataFrame, sizes: DataFrame, archived: DataFrame, budget_bytes: int) -> DataFrame:
    """(path, bytes): images to archive (SRC21), in order of their first mapping, each that still fits the budget.

    ``mappings`` (path, seq), ``sizes`` (path, bytes), ``archived`` (path). Names in
    brackets are no files. One row an image: the images of a process are few.
    """
    wanted = mappings.filter("path is not null and path <> '' and not startswith(path, '[')").groupBy("path").agg(F.min("seq").alias("seq"))
    wanted = wanted.join(archived.select("path"), "path", "left_anti").join(sizes, "path")
    ordered = wanted.agg(F.array_sort(F.collect_list(F.struct("seq", "path", "bytes"))).alias("all"))
    fits = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<path:string,bytes:bigint>>").alias("kept")),
        lambda s, x: F.when(s["used"] + x["bytes"] <= budget_bytes, F.struct((s["used"] + x["bytes"]).alias("used"), F.concat(s["kept"], F.array(F.struct(x["path"].alias("path"), x["bytes"].alias("bytes")))).alias("kept"))).otherwise(s),
    )
    return ordered.select(F.explode(fits["kept"]).alias("k")).select("k.*")


def read_jsonl(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table as JSON lines: a missing file is empty, blank lines are skipped, a bad line fails."""
    schema = TABLES[table]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
