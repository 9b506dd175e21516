"""Trace text as a table of records.

Lines are parsed by expressions, without Python: each record type has its patterns,
the type itself comes from what a line contains. A line that fits none becomes a
``decoder_error`` record; none is dropped but comments and blanks. ``seq`` orders
the lines of a stream by file, block and line, from Spark's own reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathglass.functions.scalars import parse_address, trace_time_ns
from pathglass.schemas import RECORDS

_PREFIX = r"^.*?([0-9]+)/([0-9]+)\s*(?:\[\s*([0-9]+)\s*\])?\s*(?:([0-9]+\.[0-9]+):?)?\s*"
#: Parts of a line while it is taken apart; no text holds it.
_BAR = "\x1f"
_HEX = r"^(?:0[xX])?[0-9a-fA-F]{1,16}$"


def _get(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, group), F.lit(""))


def record_type(line: Column) -> Column:
    """By substring, the first that fits; everything else should be a sample."""
    return (
        F.when(line.contains("instruction trace error") | line.contains("insn trace error"), "decoder_error")
        .when(line.contains("PERF_RECORD_LOST") | (line.contains(" lost ") & line.contains("LOST")), "lost")
        .when(line.contains("PERF_RECORD_MMAP"), "mmap")
        .when(line.contains("PERF_RECORD_COMM") | line.contains(" PERF_RECORD_EXEC") | line.contains("PERF_RECORD_FORK") | line.contains("PERF_RECORD_EXIT"), "task")
        .when(line.contains("PERF_RECORD_SWITCH"), "switch")
        .otherwise("sample")
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Rows (stream, seq, value) as RECORDS; see the module for what becomes of bad lines."""
    kept = lines.select("stream", "seq", F.rtrim("value").alias("value")).filter("value != '' and not startswith(value, '#') and not startswith(value, 'failed to read')")
    kind = record_type(F.col("value"))
    # The prefix, and what stands behind it in a sample: event, modifiers, payload,
    # instruction. One pass over the line takes them all; without a prefix there is one part.
    whole = _PREFIX + r"(?:([^:]*):\s*(?:[A-Za-z]{1,8}:)?\s*(.*)|.*)$"
    parts = F.split(F.regexp_replace("value", whole, _BAR.join(f"${k}" for k in range(1, 7))), _BAR)
    rows = kept.withColumn("kind", kind).withColumn("parts", parts)
    part = lambda k: F.when(F.size("parts") > 1, F.nullif(F.get("parts", F.lit(k)), F.lit("")))
    rows = rows.select(
        "stream", "seq", "value", "kind",
        part(0).try_cast("int").alias("p_pid"),
        part(1).try_cast("int").alias("p_tid"),
        part(2).try_cast("int").alias("p_cpu"),
        trace_time_ns(part(3)).alias("p_time"),
        F.trim(part(4)).alias("event"),
        part(5).alias("rest"),
    )
    rows = rows.withColumn("payload", F.trim(F.regexp_extract("rest", r"^(.*?)(?:\s*(?:insn|ilen|insnlen):.*)?$", 1)))
    arrow = F.col("payload").contains("=>")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    left = words(F.when(arrow, F.substring_index("payload", "=>", 1)).otherwise(F.col("payload")))
    rows = rows.withColumn("left", left).withColumn("right", words(F.when(arrow, F.substring_index("payload", "=>", -1))))
    rows = rows.withColumn("hexes", F.filter("left", lambda w: w.rlike(_HEX)))
    rows = rows.withColumn("words", F.array_join(F.filter("left", lambda w: ~w.rlike(_HEX)), " "))
    swapped = F.col("event").startswith("instructions") & (F.size("hexes") > 1)
    nth = lambda k: parse_address(F.get("hexes", F.lit(k)))
    ip = F.when(arrow, parse_address(F.try_element_at("hexes", F.lit(-1)))).when(swapped, nth(1)).otherwise(nth(0))
    addr = F.when(arrow, parse_address(F.get("right", F.lit(0)))).when(swapped, nth(0)).otherwise(nth(1))
    insn = r"\binsn:\s*((?:[0-9a-fA-F]{2}(?:\s+|$)){1,15})"
    sample_ok = F.col("p_pid").isNotNull() & F.col("event").isNotNull()

    # Side records name their task behind the record's name.
    mm = r"PERF_RECORD_MMAP2?\s.*?([0-9]+)/([0-9]+)"
    span = r"\[(0x[0-9a-fA-F]+)\((0x[0-9a-fA-F]+|[0-9a-fA-F]+)\)(?:\s*@\s*(\S+?)[\s\]])?"
    tail = r"^.*\]:\s*(\S+)\s*(.*)$"
    pair = r"PERF_RECORD_(?:FORK|EXIT)[^(]*\(\s*([0-9]+)\s*:\s*([0-9]+)\s*\)(?::\(\s*([0-9]+)\s*:\s*([0-9]+)\s*\))?"
    owner = r"PERF_RECORD_.*?([0-9]+)/([0-9]+)"
    comm = r"PERF_RECORD_COMM\s*(?:exec:)*:?\s*([^:]*)"
    value_of = lambda key: _get(rf"(?:^|\s){key}\s+([^\s:]+)", 1)

    mmap_ok = _get(span, 1).isNotNull()
    bad = ((F.col("kind") == "sample") & ~sample_ok) | ((F.col("kind") == "mmap") & ~mmap_ok) | (F.col("kind").isin("task", "switch") & F.col("p_pid").isNull())
    rows = rows.withColumn("record_type", F.when(bad, "decoder_error").otherwise(F.col("kind")))
    at = lambda kinds, c: F.when(F.col("record_type").isin(*kinds), c)
    error, task, mmap, sample = ("decoder_error",), ("task",), ("mmap",), ("sample",)
    real = F.col("kind") == "decoder_error"
    forked = F.col("value").contains("PERF_RECORD_FORK") | F.col("value").contains("PERF_RECORD_EXIT")
    no_time = F.col("record_type").isin("lost")
    columns = {
        "pid": F.coalesce(at(mmap, F.coalesce(_get(mm, 1).try_cast("int"), F.col("p_pid"), F.lit(0))), at(task, F.coalesce(F.when(forked, _get(pair, 1)).try_cast("int"), _get(owner, 1).try_cast("int"), F.col("p_pid"))), at(error, F.coalesce(F.when(real, value_of("pid")).try_cast("int"), F.col("p_pid"))), at(("sample", "switch"), F.col("p_pid"))),
        "tid": F.coalesce(at(mmap, F.coalesce(_get(mm, 2).try_cast("int"), F.col("p_tid"), F.lit(0))), at(task, F.coalesce(F.when(forked, _get(pair, 2)).try_cast("int"), _get(owner, 2).try_cast("int"), F.col("p_tid"))), at(error, F.coalesce(F.when(real, value_of("tid")).try_cast("int"), F.col("p_tid"))), at(("sample", "switch"), F.col("p_tid"))),
        "cpu": F.coalesce(at(sample, F.col("p_cpu")), at(error, F.when(real, value_of("cpu")).try_cast("int"))),
        "time_ns": F.when(no_time, None).when(F.col("record_type") == "decoder_error", F.when(real, trace_time_ns(value_of("time")))).otherwise(F.col("p_time")),
        "event": at(sample, F.when(F.col("event").startswith("branches"), "branches").when(F.col("event").startswith("instructions"), "instructions").otherwise("other")),
        "ip": F.coalesce(at(sample, ip), at(error, F.when(real, parse_address(value_of("ip"))))),
        "addr": at(sample, addr),
        "flags": at(sample, F.col("words")),
        "insn_len": at(sample, F.regexp_extract(F.coalesce("rest", F.lit("")), r"\b(?:ilen|insnlen):?\s*([0-9]+)", 1).try_cast("int")),
        "insn": at(sample, F.nullif(F.lower(F.regexp_replace(F.trim(F.regexp_extract(F.coalesce("rest", F.lit("")), insn, 1)), r"\s+", " ")), F.lit(""))),
        "start": at(mmap, parse_address(_get(span, 1))),
        "len": at(mmap, parse_address(_get(span, 2))),
        "pgoff": at(mmap, F.coalesce(parse_address(_get(span, 3)), F.lit(0).cast("long"))),
        "prot": at(mmap, F.coalesce(_get(tail, 1), F.lit(""))),
        "path": at(mmap, F.coalesce(F.regexp_replace(F.trim(_get(tail, 2)), r"\s+", " "), F.lit(""))),
        "task_kind": at(task, F.when(F.col("value").contains("PERF_RECORD_COMM") | F.col("value").contains(" PERF_RECORD_EXEC"), "comm").when(F.col("value").contains("PERF_RECORD_FORK"), "fork").otherwise("exit")),
        "ppid": at(task, F.when(forked, _get(pair, 3)).try_cast("int")),
        "ptid": at(task, F.when(forked, _get(pair, 4)).try_cast("int")),
        "comm": at(task, F.nullif(F.trim(_get(comm, 1)), F.lit(""))),
        "switch_out": at(("switch",), F.col("value").contains("SWITCH_CPU_WIDE OUT") | F.col("value").contains(" out ")),
        "lost": at(("lost",), F.coalesce(_get(r"(?:^|\s)([0-9]+)(?:\s|$)", 1).try_cast("long"), F.lit(0).cast("long"))),
        "code": at(error, F.when(real, value_of("code")).try_cast("int")),
        "message": at(error, F.trim("value")),
    }
    out = rows.select("stream", "seq", "record_type", *(c.alias(name) for name, c in columns.items()))
    return out.select(*(F.col(f.name).cast(f.dataType) for f in RECORDS))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): the lines of a file or folder; seq rises along the files in path order."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    # One row for each input split: where its numbers begin, and the bytes before its file.
    # A line takes a byte at least, so byte offset plus line number never overtakes the next split.
    splits = text.groupBy("f", "b", "size").agg(F.min("n").alias("first"))
    files = splits.select("f", "size").distinct().withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = splits.join(files.select("f", "before"), "f").select("f", "b", (F.col("before") + F.col("b") - F.col("first")).alias("base"))
    return text.join(F.broadcast(base), ["f", "b"]).select((F.col("base") + F.col("n")).alias("seq"), "value")


def read_trace_text(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of trace text; each path is a stream of its own, numbered from 0."""
    lines = None
    for stream, path in enumerate(paths):
        part = numbered_lines(spark, path).withColumn("stream", F.lit(stream))
        lines = part if lines is None else lines.unionByName(part)
    return parse_records(lines)


def parse_statistics(records: DataFrame) -> DataFrame:
    """One row of counters: records, samples, side records and lines that could not be read."""
    of = lambda c, name: F.count_if(c).alias(name)
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        of(F.col("record_type") == "sample", "samples"),
        of(F.col("record_type").isin("mmap", "task", "switch"), "side_records"),
        of((F.col("record_type") == "decoder_error") & F.col("code").isNull(), "unparsed"),
    )
