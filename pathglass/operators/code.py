"""Bytes of images: pages of them, instructions decoded from them, blocks counted in them (PRJ9, AGG7).

Contents are pages keyed by (image, page), so that a lookup is an equi-join, however
large an image is. Places and blocks are made distinct before they are looked up and
decoded: work grows with the code that ran, not with how often it ran.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathglass.functions import x86
from pathglass.functions.scalars import thread_name
from pathglass.operators import symbols
from pathglass.operators.branches import MAX_BLOCK
from pathglass.schemas import INLINE_ROWS
from pathglass.storage import counted, cut

PAGE_BITS = 12
PAGE = 1 << PAGE_BITS


def code_pages(files: DataFrame) -> DataFrame:
    """(image_id, page, bytes) of ``files`` (image_id, content); empty files have no pages."""
    pages = F.sequence(F.lit(0).cast("long"), F.shiftright(F.octet_length("content").cast("long") - 1, PAGE_BITS))
    rows = files.filter(F.octet_length("content") > 0).select("image_id", "content", F.explode(pages).alias("page"))
    return rows.select("image_id", "page", F.expr(f"substring(content, int(page * {PAGE}) + 1, {PAGE})").alias("bytes"))


def read_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(images, code): path, image_id (SHA-256 of the content) and size of every file below ``folder``, and their pages (SRC18)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.sha2("content", 256).alias("image_id"), F.col("length").alias("bytes"), "content")
    return named.drop("content"), code_pages(named.select("image_id", "content")).dropDuplicates(["image_id", "page"])


def read_bytes(places: DataFrame, code: DataFrame) -> DataFrame:
    """``places`` (id, image_id, at, n) with ``bytes``: up to n from offset ``at`` on, fewer at the end, null where there are none.

    A stretch over page borders meets each of its pages and is put together again.
    """
    first, last = F.shiftright("at", PAGE_BITS), F.shiftright(F.col("at") + F.col("n") - 1, PAGE_BITS)
    asked = places.filter("at >= 0 and n > 0").select("id", "image_id", "at", "n", F.explode(F.sequence(first, last)).alias("page"))
    begin = F.greatest(F.col("at") - F.col("page") * PAGE, F.lit(0).cast("long"))
    met = asked.join(code, ["image_id", "page"]).withColumn("begin", begin)
    met = met.select("id", "at", "page", F.expr(f"substring(bytes, int(begin) + 1, int(at + n - page * {PAGE} - begin))").alias("piece"))
    # At most as many pieces as the longest stretch has pages.
    pieces = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "piece"))).alias("pieces"), F.first(first).alias("first"))
    whole = F.aggregate(
        "pieces",
        F.struct(F.col("first").alias("next"), F.lit(b"").alias("bytes")),
        lambda s, p: F.when(p["page"] == s["next"], F.struct((s["next"] + 1).alias("next"), F.concat(s["bytes"], p["piece"]).alias("bytes"))).otherwise(s),
        lambda s: s["bytes"],
    )
    joined = pieces.select("id", whole.alias("bytes")).filter(F.octet_length("bytes") > 0)
    return places.join(joined, "id", "left")


def decoded(rows: DataFrame) -> DataFrame:
    """``rows`` (id, bytes) with kind, len, targeted and displacement of the instruction that the bytes begin with.

    What is no whole valid instruction is ``other`` and one byte long; without bytes the length is 0.
    """

    def run(batches):
        for b in batches:
            raw = [x or b"" for x in b.column("bytes").to_pylist()]
            length, kind, targeted, displacement = x86.decode(*x86.windows(raw))
            length = length + ((length == 0) & [len(x) > 0 for x in raw])
            names = pa.array([x86.KINDS[k] for k in kind.tolist()], pa.string())
            columns = [b.column("id"), b.column("bytes"), names, pa.array(length, pa.int32()), pa.array(targeted), pa.array(displacement)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "bytes", "kind", "len", "targeted", "displacement"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "bytes").mapInArrow(run, f"id {kind}, bytes binary, kind string, len int, targeted boolean, displacement long")


def flow(ip: Column) -> dict[str, Column]:
    """kind, len, branch_target and fallthrough at ``ip`` from what :func:`decoded` adds (PRJ9)."""
    after = ip + F.col("len")
    target = F.when(F.col("targeted"), after + F.col("displacement")).when(F.col("kind") == "call", F.lit(0).cast("long"))
    known = (F.col("len") > 0) & (F.col("kind") != "return")
    return {"kind": F.coalesce("kind", F.lit("other")), "len": F.coalesce("len", F.lit(0)), "branch_target": target, "fallthrough": F.when(known, after)}


def instruction_code(rows: DataFrame, places: DataFrame, code: DataFrame | None) -> DataFrame:
    """``rows`` (id, insn) with bytes, kind, len, targeted and displacement: the bytes that a row states as hex, or
    those of its image. ``places`` is (id, image_id, file_offset) of the rows, whose other columns pass through."""
    stated = rows.filter("insn is not null").select(F.col("insn").alias("id")).distinct()
    raw = F.unhex(F.regexp_replace("id", r"\s+", ""))
    spelled = decoded(cut(stated.withColumn("bytes", raw), "stated"))
    by_text = counted(cut(spelled.withColumnRenamed("id", "insn"), "stated-decoded"))
    known = rows.filter("insn is not null").join(by_text, "insn", "left").drop("insn")
    silent = rows.filter("insn is null").drop("insn")
    columns = {"bytes": "binary", "kind": "string", "len": "int", "targeted": "boolean", "displacement": "long"}
    if code is None:
        return known.unionByName(silent.withColumns({n: F.lit(None).cast(t) for n, t in columns.items()}))
    at = silent.join(places.filter("image_id is not null").select("id", "image_id", "file_offset"), "id")
    distinct = at.select("image_id", "file_offset").distinct()
    distinct = cut(distinct.select(F.struct("image_id", "file_offset").alias("id"), "image_id", F.col("file_offset").alias("at"), F.lit(x86.LONGEST).cast("long").alias("n")), "executed-places")
    found = decoded(read_bytes(distinct, code).filter("bytes is not null").select("id", "bytes"))
    by_place = counted(cut(found.select("id.*", *columns), "executed-decoded"))
    from_image = at.join(by_place, ["image_id", "file_offset"]).select("id", *columns)
    return known.unionByName(silent.join(from_image, "id", "left"))


PARTED = ("part", "pid", "tid")


def before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` (part, pid, tid, seq) with the ``value`` of the thread's row before; null at its first one.

    Within a range of the stream by a window, over its borders by one row a range and thread.
    """
    rows = rows.withColumn("__v", F.struct(value.alias("v")))
    ends = rows.groupBy(*PARTED).agg(F.max_by("__v", "seq").alias("__v"))
    carried = ends.select(*PARTED, F.last("__v", ignorenulls=True).over(Window.partitionBy("pid", "tid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))
    inner = F.lag("__v").over(Window.partitionBy(*PARTED).orderBy("seq"))
    return rows.withColumn("__i", inner).join(carried, list(PARTED)).withColumn(name, F.coalesce("__i", "__c")["v"]).drop("__v", "__i", "__c")


def executed_blocks(rows: DataFrame) -> DataFrame:
    """(pid, tid, seq, start, end, elapsed_ns): straight runs between two branches of a thread (WIN3).

    ``rows`` are classified branch samples and task records with ``part``. A run begins
    where a branch went and ends at the next branch, unless tracing ended, was
    interrupted or began between; an exit ends the thread. Runs backwards or over more
    than MAX_BLOCK bytes are none.
    """
    leaves = (F.col("record_type") == "task") & (F.col("task_kind") == "exit")
    rows = rows.filter((F.col("record_type") == "sample") | leaves).filter("pid is not null and tid is not null")
    broken = leaves | F.col("trace_end") | F.col("async_event") | F.col("interrupt")
    goes = F.when(~F.coalesce(broken, F.lit(False)) & (F.col("addr") != 0), F.struct(F.col("addr").alias("start"), F.col("time_ns").alias("at")))
    rows = before(rows.select(*PARTED, "seq", "record_type", "task_kind", "time_ns", "ip", "addr", "trace_begin", "trace_end", "async_event", "interrupt"), goes, "came")
    met = rows.filter("record_type = 'sample' and came is not null and ip is not null and not trace_begin")
    passed = F.col("time_ns") - F.col("came.at")
    out = met.select("pid", "tid", "seq", F.col("came.start").alias("start"), F.col("ip").alias("end"), F.when(passed >= 0, passed).otherwise(0).alias("elapsed_ns"))
    return out.filter((F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") <= MAX_BLOCK))


def block_code(blocks: DataFrame, mappings: DataFrame, images) -> DataFrame:
    """(pid, start, end, function, chain, instructions) of distinct ``blocks`` (pid, start, end, seq).

    Of the mappings before ``seq`` that hold a whole block the newest counts. Its chain is that of the
    inlined functions at its start, innermost first; instructions are read from the image's
    bytes at its start up to its last branch. Blocks without mapping, image or bytes are left out.
    """
    blocks = blocks.withColumn("id", F.struct("pid", "start", "end"))
    probes = blocks.select("id", "pid", F.col("start").alias("ip"), F.col("end").alias("upto"), "seq")
    hits = symbols.map_addresses(probes, mappings.select("pid", "start", "end", "seq", "generation", "pgoff", "path"))
    known = counted(cut(images.images.groupBy("path").agg(F.min("image_id").alias("image_id")), "images"))
    offset = F.col("ip") - F.col("map_start") + F.col("pgoff")
    hits = cut(hits.join(known, "path").select("id", "image_id", offset.alias("file_offset"), (F.col("upto") - F.col("ip")).alias("reach")), "blocks-mapped")
    needed = hits.select("id", "image_id", F.col("file_offset").alias("at"), (F.col("reach") + 1 + x86.LONGEST).alias("n"), "reach")
    with_code = read_bytes(needed, images.code).filter(F.octet_length("bytes") > F.col("reach"))

    def count(batches):
        for b in batches:
            n = x86.count_instructions(b.column("bytes").to_pylist(), b.column("reach").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], ["id", "instructions"])

    sizes = with_code.select("id", "bytes", "reach").mapInArrow(count, "id struct<pid:int,start:bigint,end:bigint>, instructions long")
    found = symbols.file_offset_address(hits.select("id", "image_id", "file_offset"), images.segments).withColumn("address", F.coalesce("address", "file_offset"))
    named = symbols.inline_frames(symbols.symbolize(found.select("id", "image_id", "address"), images.functions), images.inline)
    names = F.transform(F.coalesce("frames", F.array().cast(images.inline.schema["frames"].dataType)), lambda f: f["function"])
    # A list that ends with the function itself names it as the outermost frame.
    outer = F.try_element_at(names, F.lit(-1)).eqNullSafe(F.col("symbol")) & F.col("symbol").isNotNull()
    chain = F.when(outer, F.slice(names, F.lit(1), F.size(names) - 1)).otherwise(names)
    return sizes.join(named.select("id", "function", chain.alias("chain")), "id").select("id.*", "function", "chain", "instructions")


def inline_rows(rows: DataFrame, mappings: DataFrame, images, names: DataFrame | None = None) -> DataFrame:
    """INLINE_ROWS: instructions, blocks and time of each thread by function and inline chain (AGG7).

    ``rows`` is what :func:`executed_blocks` takes; ``names`` (pid, tid, thread) are the
    threads that rows go by, ``t_<tid>`` where it has none.
    """
    ran = cut(executed_blocks(rows), "blocks")
    # A thread's runs of one block are added up before anything is looked up.
    sums = ran.groupBy("pid", "tid", "start", "end").agg(F.count(F.lit(1)).alias("blocks"), F.sum("elapsed_ns").alias("elapsed_ns"))
    distinct = ran.groupBy("pid", "start", "end").agg(F.min("seq").alias("seq"))
    facts = cut(block_code(cut(distinct, "distinct-blocks"), mappings, images), "block-code")
    out = sums.join(counted(facts), ["pid", "start", "end"])
    out = out.groupBy("pid", "tid", "function", "chain").agg(F.sum(F.col("instructions") * F.col("blocks")).alias("instructions"), F.sum("blocks").alias("blocks"), F.sum("elapsed_ns").alias("elapsed_ns"))
    usual = thread_name(F.col("tid"), F.lit(0))
    out = out.withColumn("thread", usual) if names is None else out.join(names, ["pid", "tid"], "left").withColumn("thread", F.coalesce("thread", usual))
    return out.select(*(F.col(f.name).cast(f.dataType) for f in INLINE_ROWS))
