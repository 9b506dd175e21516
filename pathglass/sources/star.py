"""The star tables read as traces: orders and their lines as spans, events as records.

An order is a root span on its customer's thread, named by its priority; its lines
are child spans, named by their part's brand, and overlap each other. Orders without a
specified priority have no function. The event stream is a stream of branch records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathglass.operators.code import code_pages
from pathglass.operators.locate import Images

#: 1995-01-01 in nanoseconds since the epoch: the snapshot's origin.
ORIGIN_NS = 788_918_400_000_000_000


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ns(timestamp: str):
    return F.unix_micros(F.col(timestamp).cast("timestamp")) * 1000 - ORIGIN_NS


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name): priorities are numbered by their first digit, brands from 100 on."""
    orders = star(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    parts = star(spark, sf_dir, "part").select("p_brand").distinct()
    roots = orders.filter("not startswith(o_orderpriority, '4')").select(F.substring("o_orderpriority", 1, 1).cast("long").alias("id"), F.concat(F.lit("order::"), "o_orderpriority").alias("name"))
    leaves = parts.select((F.substring_index("p_brand", "#", -1).cast("long") + 100).alias("id"), F.concat(F.lit("part::"), "p_brand").alias("name"))
    return roots.unionByName(leaves)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, thread, function, parent, start_ns, end_ns, completeness)."""
    orders = star(spark, sf_dir, "orders")
    is_open = F.col("o_orderstatus") == "O"
    start = _ns("o_orderdate")
    roots = orders.select(
        (F.col("o_orderkey") * 100).alias("id"),
        F.concat(F.lit("t_"), F.col("o_custkey").cast("string")).alias("thread"),
        F.when(~F.col("o_orderpriority").startswith("4"), F.substring("o_orderpriority", 1, 1).cast("long")).alias("function"),
        F.lit(None).cast("long").alias("parent"),
        start.alias("start_ns"),
        F.when(~is_open, start + F.round(F.col("o_totalprice") * 100).cast("long")).alias("end_ns"),
        F.when(is_open, "open_end").otherwise("complete").alias("completeness"),
    )
    lines = star(spark, sf_dir, "lineitem")
    part = star(spark, sf_dir, "part").select("p_partkey", (F.substring_index("p_brand", "#", -1).cast("long") + 100).alias("function"))
    lines = lines.join(part, lines["l_partkey"] == part["p_partkey"], "left")
    # Lines are numbered where they meet their order.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    parents = orders.select("o_orderkey", F.concat(F.lit("t_"), F.col("o_custkey").cast("string")).alias("thread"), start.alias("parent_start"), F.col("o_orderstatus").alias("o_status"))
    cut_short = (F.col("l_returnflag") == "R") & (F.col("o_status") == "F")
    lines = lines.withColumn("rn", F.row_number().over(order)).join(parents, lines["l_orderkey"] == parents["o_orderkey"]).withColumn("parent", F.col("l_orderkey") * 100)
    begin = F.col("parent_start") + F.col("rn") * 1_000_000
    children = lines.select(
        (F.col("l_orderkey") * 100 + F.col("rn")).alias("id"),
        "thread",
        "function",
        "parent",
        begin.alias("start_ns"),
        F.when(~cut_short, begin + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("end_ns"),
        F.when(cut_short, "interrupted_by_gap").otherwise("complete").alias("completeness"),
    )
    return roots.unionByName(children)


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as deep as a user's history: each event is called by the user's event before it, and stays open."""
    e = star(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t_"), F.col("user_id").cast("string")).alias("thread"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 5).alias("function"),
        F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("parent"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("start_ns"),
        F.lit(None).cast("long").alias("end_ns"),
        F.lit("open_end").alias("completeness"),
    )


def chain_functions(spark: SparkSession) -> DataFrame:
    return spark.range(5).select("id", F.concat(F.lit("step"), F.col("id").cast("string")).alias("name"))


def inline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread, function, chain, instructions, blocks, elapsed_ns): a block run for each line item."""
    lines, orders, part = (star(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
    return rows.select(
        F.concat(F.lit("t_"), F.col("o_custkey").cast("string")).alias("thread"),
        F.when(~F.col("o_orderpriority").startswith("4"), F.substring("o_orderpriority", 1, 1).cast("long")).alias("function"),
        F.array("p_type", "p_brand").alias("chain"),  # innermost first
        F.col("l_quantity").cast("long").alias("instructions"),
        F.lit(1).cast("long").alias("blocks"),
        F.round(F.col("l_extendedprice")).cast("long").alias("elapsed_ns"),
    )


#: Flags that stand for an event type.
EVENT_FLAGS = {"view": "call", "purchase": "return", "click": "jcc", "error": "async"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as branch samples of RECORDS' columns, a thread for each user."""
    return records_of(star(spark, sf_dir, "events"))


def records_of(e: DataFrame, *also: str) -> DataFrame:
    """Events, of a table or a stream, as samples; columns ``also`` of the events stand behind.

    Signups end and restart tracing in turn; addresses follow from ids and ``props``.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    flags = F.create_map(*(F.lit(x) for pair in EVENT_FLAGS.items() for x in pair))
    signup = F.when(F.col("event_id") % 2 == 0, "tr end call").otherwise("tr strt")
    return e.select(
        F.lit(0).alias("stream"),
        F.col("event_id").alias("seq"),
        F.lit("sample").alias("record_type"),
        F.lit(1).alias("pid"),
        F.col("user_id").cast("int").alias("tid"),
        F.pmod("event_id", F.lit(8)).cast("int").alias("cpu"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"),
        F.lit("branches").alias("event"),
        (F.lit(4096) + (F.col("event_id") % 7) * 256 + k % 16).alias("ip"),
        (F.lit(4096) + (k % 7) * 256).alias("addr"),
        F.coalesce(F.try_element_at(flags, F.col("event_type")), signup).alias("flags"),
        *also,
    )


#: Bytes of the instruction that an event type stands for; an error is one that could not be read.
EVENT_BYTES = {"click": "74 0e", "view": "90", "purchase": "ff d0", "signup": "c3"}


def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as instruction samples and decoder errors of one process, a thread for each user."""
    rows = records_of(star(spark, sf_dir, "events"), "event_type")
    bytes_ = F.create_map(*(F.lit(x) for pair in EVENT_BYTES.items() for x in pair))
    rows = rows.drop("event").withColumn("insn", F.try_element_at(bytes_, F.col("event_type")))
    return rows.select(
        "seq", "pid", "tid", "time_ns", "ip", "insn",
        F.concat(F.lit("t_"), F.col("tid").cast("string")).alias("thread"),
        F.when(F.col("insn").isNull(), "decoder_error").otherwise("sample").alias("record_type"),
        F.lit(None).cast("string").alias("task_kind"),
        F.lit("instructions").alias("event"),
        F.floor((F.length("insn") + 1) / 3).cast("int").alias("insn_len"),
    )


def code(spark: SparkSession) -> tuple[DataFrame, Images]:
    """Where the event stream runs: (mappings, images).

    An old mapping of an unknown image, replaced by one of a known image whose segment
    covers the first four of seven blocks; a function and an inlined range a block.
    """
    mappings = spark.createDataFrame([(1, 4096, 8192, 0, "r-xp", "/bin/old", -2, 0, 0), (1, 4096, 5632, 256, "r-xp", "/bin/star", -1, 1, 0)], "pid int, start long, end long, pgoff long, prot string, path string, seq long, generation long, valid_from long")
    block = lambda width, size: F.lit(0x400000) + F.col("id") * width + size
    blocks = spark.range(7)
    functions = blocks.select(F.lit("i").alias("image_id"), "id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), block(256, 0).alias("start"), block(256, 12).alias("end"))
    frame = F.struct(F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("function"), F.lit("g.c").alias("file"), F.col("id").cast("int").alias("line"))
    inline = blocks.select(F.lit("i").alias("image_id"), block(256, 4).alias("lo"), block(256, 8).alias("hi"), F.array(frame).alias("frames"))
    return mappings, Images(spark.createDataFrame([("/bin/star", "i")], "path string, image_id string"), spark.createDataFrame([("i", 256, 1024, 0x400000)], "image_id string, file_off long, file_size long, vaddr long"), functions, inline)


#: The 16 bytes that the image /bin/star repeats: jz +2; nop; mov rbp,rsp; call +0; call rax; ret; jmp -112.
LINE = "74 02 90 48 89 e5 e8 00 00 00 00 ff d0 c3 eb 90"


def code_with_bytes(spark: SparkSession) -> tuple[DataFrame, Images]:
    """:func:`code`, with the contents of the known image: LINE from its first byte on, 2048 bytes."""
    mappings, images = code(spark)
    content = spark.createDataFrame([("i", bytearray(bytes.fromhex(LINE) * 128))], "image_id string, content binary")
    return mappings, images._replace(code=code_pages(content))


def executed_with_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as instruction samples, errors and exits. Half of the samples state the bytes
    that the image holds at their address; errors name their task or, every third, none."""
    rows = records_of(star(spark, sf_dir, "events"), "event_type")
    k = F.col("seq") % 3
    error = F.col("event_type") == "error"
    nowhere, leaves = error & (k == 0), error & (k == 1)
    line = LINE.replace(" ", "") * 2
    stated = F.substring(F.lit(line), 2 * (F.col("ip") % 16).cast("int") + 1, F.lit(30))
    return rows.drop("event", "record_type").select(
        "seq", F.when(~nowhere, F.col("pid")).alias("pid"), F.when(~nowhere, F.col("tid")).alias("tid"), "time_ns", F.when(~error, F.col("ip")).alias("ip"),
        F.when(leaves, "task").when(error, "decoder_error").otherwise("sample").alias("record_type"),
        F.when(leaves, "exit").alias("task_kind"), F.when(~error, "instructions").alias("event"),
        F.when(~error & (F.col("seq") % 2 == 0), F.rtrim(F.regexp_replace(stated, "(..)", "$1 "))).alias("insn"),
    )


def records_of_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with all that can befall a stack: what was an asynchronous transfer is, in turn, that, a
    hardware interrupt, a system call, an error with and without a missing image, or an exit; some times lie two
    hours early, and some tracing ends at a system call."""
    rows = two_streams(spark, sf_dir).withColumn("stream", F.lit(0))
    k, was, end = F.col("seq") % 6, F.col("flags") == "async", F.col("flags") == "tr end call"
    error, leaves = was & k.isin(3, 4), was & (k == 5)
    flags = F.when(was & (k == 1), "hw int").when(was & (k == 2), "syscall").when(end & (F.col("seq") % 4 == 0), "tr end syscall").otherwise(F.col("flags"))
    return rows.withColumns({
        "record_type": F.when(error, "decoder_error").when(leaves, "task").otherwise("sample"),
        "task_kind": F.when(leaves, "exit"),
        "code": F.when(error & (k == 3), 5),
        "message": F.when(error, "bad"),
        "flags": F.when(~error & ~leaves, flags),
        "ip": F.when(~error & ~leaves, F.col("ip")),
        "addr": F.when(~error & ~leaves, F.col("addr")),
    })


def records_of_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream over four processes, of which the first is forked by none and has forked the third:
    signups are forks, purchases mappings, errors name their thread, their process alone, or nothing."""
    rows = records_of(star(spark, sf_dir, "events"), "event_type")
    pid, kind, k = F.col("tid") % 4 + 1, F.col("event_type"), F.col("seq") % 4
    error = kind == "error"
    return rows.drop("record_type", "pid", "event").select(
        "seq", "time_ns",
        F.when(error, "decoder_error").when(kind == "signup", "task").when(kind == "purchase", "mmap").otherwise("sample").alias("record_type"),
        F.when(~(error & (k == 0)), pid).alias("pid"), F.when(~(error & k.isin(0, 1)), F.col("tid")).alias("tid"),
        F.when(kind == "signup", "fork").alias("task_kind"), F.when((kind == "signup") & (pid > 1), pid - 2).alias("ppid"), F.lit(None).cast("string").alias("comm"),
    )


def two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as two, of the even and of the odd cpus; some times lie two hours early."""
    rows = records(spark, sf_dir)
    late = F.when(F.col("seq") % 31 == 0, 7_200_000_000_000).otherwise(0)
    return rows.withColumns({"stream": (F.col("cpu") % 2).cast("int"), "time_ns": F.col("time_ns") - late})


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as instruction rows: sites from ``props``, outcomes from ``value``."""
    e = star(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kinds = F.create_map(*(F.lit(x) for pair in {"click": "conditional", "view": "sequential", "purchase": "indirect_call", "signup": "return", "error": "other"}.items() for x in pair))
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other"))
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t_"), F.col("user_id").cast("string")).alias("thread"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("sequence"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"),
        (F.lit(0x400000) + k * 16).alias("virt_ip"),
        F.concat(F.lit("f"), (k % 5).cast("string")).alias("symbol"),
        F.when(k % 3 != 0, F.concat(F.lit("g"), (k % 3).cast("string"))).alias("inlined"),
        kind.alias("kind"),
        F.when(kind.isin("conditional", "indirect_call"), F.lit(0x500000) + (F.col("event_id") % 11) * 16).alias("branch_target"),
        F.when(kind == "conditional", F.when(F.col("value") >= 30, "taken").when(F.col("value") >= 5, "not_taken").otherwise("unknown")).alias("outcome"),
    )
