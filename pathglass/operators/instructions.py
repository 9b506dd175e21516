"""Instruction rows from instruction samples (STR2): kinds, outcomes, sequence and place.

What a sample needs to know of its thread (whether an exit came before, how many samples
and errors went by, what ran next) is counted within ranges of the stream and carried
over their borders by one row a range and thread, so that a thread that holds most of
the stream spreads over tasks. Errors that name no task count for every thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathglass.functions.scalars import thread_name
from pathglass.operators.code import PARTED, flow, instruction_code
from pathglass.operators.locate import Images, locate, mappings_of
from pathglass.operators.reconstruct import with_event_ids
from pathglass.schemas import INSTRUCTIONS
from pathglass.storage import counted, cut

_ERROR, _SAMPLE, _EXIT = "decoder_error", "sample", "task"


def _so_far(what: Column) -> Column:
    """Rows of the thread's earlier records in the same range that ``what`` holds for."""
    own = Window.partitionBy(*PARTED).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(what.cast("long")).over(own), F.lit(0).cast("long"))


def _earlier(what: Column) -> Column:
    """Of one row for each range and thread: over the ranges before."""
    return what.over(Window.partitionBy("pid", "tid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def with_epoch(records: DataFrame) -> DataFrame:
    """``records`` (part, seq) with ``epoch``, the number of errors before them that name no task: one row a range carries it on."""
    nowhere = (F.col("record_type") == _ERROR) & (F.col("pid").isNull() | F.col("tid").isNull())
    sizes = records.groupBy("part").agg(F.count_if(nowhere).alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum(nowhere.cast("long")).over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return records.join(F.broadcast(base), "part").withColumn("epoch", F.col("base") + own).drop("base")


def sequenced(records: DataFrame) -> DataFrame:
    """The instruction samples of ``records`` (RECORDS with ``part``) with generation, thread, sequence, next_ip and
    next_lost (WIN1, WIN2, WIN5).

    ``sequence`` numbers a thread's samples from 1 and skips a number for each error of
    the thread, or of no known task, behind the first of them. The first sample behind an
    exit begins a generation, and with it the numbers. ``next_ip`` is where the thread's next
    sample is, whatever its generation; ``next_lost`` whether an error lies between.
    """
    rows = with_epoch(records.filter(f"(record_type = '{_SAMPLE}' and event = 'instructions') or record_type = '{_ERROR}' or (record_type = '{_EXIT}' and task_kind = 'exit')"))
    rows = rows.filter("pid is not null and tid is not null")
    sample, error, leaves = (F.col("record_type") == t for t in (_SAMPLE, _ERROR, _EXIT))
    seen = sample | leaves
    # An exit counts unless it directly follows another: errors between do not matter.
    own = Window.partitionBy(*PARTED).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last(F.when(seen, F.col("record_type")), ignorenulls=True).over(own))
    rows = rows.withColumns({"samples": _so_far(sample), "errors": _so_far(error), "closes": leaves & (F.col("last") == _SAMPLE), "opening": leaves & F.col("last").isNull()})
    rows = cut(rows.withColumns({"closed": _so_far(F.col("closes")), "opened": _so_far(F.col("opening"))}), "instruction-threads")
    ends = rows.groupBy(*PARTED).agg(
        F.count_if(sample).alias("samples"),
        F.count_if(error).alias("errors"),
        F.count_if("closes").alias("closes"),
        F.max(F.col("opening").cast("int")).alias("opening"),
        F.max_by("record_type", F.when(seen, F.col("seq"))).alias("last"),
        F.min_by(F.struct("ip", "errors", "epoch"), F.when(sample, F.col("seq"))).alias("head"),
    )
    # An exit that a range begins with counts if it follows a sample, or nothing.
    ends = ends.withColumn("opens", (F.col("opening") == 1) & F.coalesce(_earlier(F.last("last", ignorenulls=True)) == _SAMPLE, F.lit(True)))
    ends = ends.withColumns({f"{n}_in": F.coalesce(_earlier(F.sum(c)), F.lit(0).cast("long")) for n, c in (("samples", F.col("samples")), ("errors", F.col("errors")), ("closed", F.col("closes") + F.col("opens").cast("long")))})
    head = F.when(F.col("head").isNotNull(), F.struct(F.col("head.ip").alias("ip"), (F.col("errors_in") + F.col("head.errors") + F.col("head.epoch")).alias("lost")))
    later = Window.partitionBy("pid", "tid").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumn("own_head", head).withColumn("head_out", F.first("own_head", ignorenulls=True).over(later))
    rows = rows.join(ends.select(*PARTED, "opens", "samples_in", "errors_in", "closed_in", "head_out"), list(PARTED)).filter(sample)
    rows = rows.withColumns({
        "generation": (F.col("closed_in") + F.col("closed") + F.when(F.col("opens"), F.col("opened")).otherwise(0)).cast("int"),
        "samples": F.col("samples_in") + F.col("samples"),
        "lost": F.col("errors_in") + F.col("errors") + F.col("epoch"),
    })
    rows = cut(rows.drop("samples_in", "errors_in", "closed_in", "closed", "opened", "opens", "closes", "opening", "last"), "instruction-order")
    # One row for each generation: what had gone by when it began.
    begins = counted(cut(rows.groupBy("pid", "tid", "generation").agg(F.min("samples").alias("samples_0"), F.min("lost").alias("lost_0")), "generations"))
    rows = rows.join(begins, ["pid", "tid", "generation"])
    own = Window.partitionBy(*PARTED).orderBy("seq")
    following = F.coalesce(F.lead(F.struct("ip", "lost")).over(own), "head_out")
    rows = rows.withColumn("following", following)
    return rows.withColumns({
        "thread": thread_name(F.col("tid"), F.col("generation")),
        "sequence": 1 + F.col("samples") - F.col("samples_0") + F.col("lost") - F.col("lost_0"),
        "next_ip": F.when(F.col("following").isNotNull(), F.coalesce("following.ip", F.lit(0).cast("long"))),
        "next_lost": F.col("following.lost") > F.col("lost"),
    }).drop("following", "samples", "samples_0", "lost", "lost_0", "head_out", "epoch")


def outcome() -> Column:
    """Of a conditional: taken or not taken by where the thread ran next; unknown at the end, across an error,
    anywhere else, or if both places are one."""
    there = F.col("next_ip") == F.col("branch_target")
    straight = F.col("next_ip") == F.col("fallthrough")
    lost = F.coalesce("next_lost", F.lit(True)) | (F.col("branch_target") == F.col("fallthrough"))
    return F.when(F.col("kind") == "conditional", F.when(lost, "unknown").when(there, "taken").when(straight, "not_taken").otherwise("unknown"))


def instruction_rows(records: DataFrame, images: Images, mappings: DataFrame | None = None, start_ns: int | None = None, end_ns: int | None = None, thread: str | None = None) -> DataFrame:
    """The instruction samples of ``records`` as INSTRUCTIONS.

    Kind, length and targets come from the bytes that a sample states, else from those
    of its image; without either it is ``other``. A window of time, half open, or a
    thread selects what is decoded and given; the samples behind it still tell how its last
    branches went (FLT13).
    """
    records = records if "part" in records.columns else with_event_ids(records)
    mappings = mappings_of(records) if mappings is None else mappings
    ran = sequenced(records).withColumn("ip", F.coalesce("ip", F.lit(0).cast("long")))
    for low, high in ((start_ns, None), (None, end_ns)):
        if low is not None or high is not None:
            ran = ran.filter(F.col("time_ns") >= low if low is not None else F.col("time_ns") < high)
    ran = ran if thread is None else ran.filter(F.col("thread") == thread)
    ran = cut(ran.select("pid", "seq", "time_ns", "ip", "insn", "thread", "sequence", "next_ip", "next_lost"), "sequenced")
    at = cut(locate(ran.select(F.col("seq").alias("id"), "pid", "ip", "seq"), mappings, images), "instruction-places")
    out = instruction_code(ran.withColumnRenamed("seq", "id"), at, images.code).join(at, "id", "left")
    out = out.withColumns(flow(F.col("ip")))
    shown = F.rtrim(F.regexp_replace(F.lower(F.hex(F.coalesce("bytes", F.lit(b"")))), "(..)", "$1 "))
    columns = {"location": F.lit(None), "virt_ip": F.col("ip"), "outcome": outcome(), "bytes_hex": shown}
    return out.select(*(columns.get(f.name, F.col(f.name) if f.name not in columns else None).cast(f.dataType).alias(f.name) for f in INSTRUCTIONS))
