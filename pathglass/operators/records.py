"""The record stream: merging, the process tree, coverage, gaps and thread generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathglass.functions.scalars import thread_name
from pathglass.storage import cut

#: Segments listed for a thread; counts and sums cover all.
LISTED_SEGMENTS = 32
#: Threads in a summary.
TOP_THREADS = 32


def merge_streams(streams: list[DataFrame]) -> DataFrame:
    """One table of all streams (JN15): side records of the first only, ``ord`` orders equal times by stream.

    Records without a time go with time 0. The order is a column, (at, stream, seq):
    downstream work sorts within its own groups and never as a whole.
    """
    out = None
    for number, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(number))
        if number:
            s = s.filter(~F.col("record_type").isin("mmap", "task"))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("at", F.coalesce("time_ns", F.lit(0).cast("long")))


#: Records that every stream repeats; only the first stream's count.
SIDE_RECORDS = ("mmap", "task", "switch", "lost")


def in_ranges(records: DataFrame) -> DataFrame:
    """``records`` in one order of ``seq``, written in ranges of it with their number ``part`` (JN15, STR3).

    Several streams are merged by time as their heads would be: a record without a time, or with an earlier
    one than those before it in its stream, follows directly behind them. Equal times go by stream. Side
    records count in the first stream only. ``seq`` is numbered anew then; of a single stream it stays.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ranged(rows: DataFrame, what: str, *order: str) -> DataFrame:
        return cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), what)

    if "stream" not in records.columns:
        return ranged(records, "stream-order", "seq")
    rows = ranged(records, "stream-order", "stream", "seq")
    streams = [r["stream"] for r in rows.select("stream").distinct().limit(2).collect()]
    if len(streams) < 2:
        return rows
    # The latest time so far, within ranges and over their borders by one row a range and stream.
    at = F.coalesce("time_ns", F.lit(0).cast("long"))
    inner = F.max(at).over(Window.partitionBy("part", "stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("part", "stream").agg(F.max(at).alias("latest"))
    ends = ends.select("part", "stream", F.max("latest").over(Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.withColumn("at", inner).join(F.broadcast(ends), ["part", "stream"]).withColumn("at", F.greatest("at", "carried"))
    first = rows.agg(F.min("stream")).first()[0]
    rows = rows.filter((F.col("stream") == first) | ~F.col("record_type").isin(*SIDE_RECORDS)).drop("part", "carried")
    merged = ranged(rows, "merged", "at", "stream", "seq")
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("at", "stream", "seq")) - 1
    return merged.withColumn("rank", rank).join(F.broadcast(base), "part").withColumn("seq", F.col("base") + F.col("rank")).drop("at", "rank", "base")


def process_tree(forks: DataFrame, roots: DataFrame) -> DataFrame:
    """(pid, depth) of everything reachable from the roots over FORK records (STR8).

    ``forks`` is (parent, child), ``roots`` (pid). Rounds follow the depth of the
    tree and are written out; a process reached twice keeps its smallest depth.
    """
    edges = forks.select("parent", "child").distinct()
    found = cut(roots.select("pid").distinct().withColumn("depth", F.lit(0).cast("long")), "tree")
    front = found
    while True:
        step = front.join(edges, front["pid"] == edges["parent"]).select(F.col("child").alias("pid"), (F.col("depth") + 1).alias("depth")).distinct()
        front = cut(step.join(found.select("pid"), "pid", "left_anti"), "tree-front")
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front), "tree")


def live_samples(samples: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of traced processes, and the number of the others (JN13)."""
    pids = tree.select("pid")
    return samples.join(pids, "pid", "left_semi"), samples.join(pids, "pid", "left_anti").agg(F.count(F.lit(1)).alias("foreign"))


def generations(records: DataFrame) -> DataFrame:
    """``records`` with ``generation`` and ``thread`` (WIN5): a tid that exits is a new thread from then on.

    An exit counts if its thread was seen since the last one; the exit itself still belongs
    to the thread that ends.
    """
    by = Window.partitionBy("pid", "tid").orderBy("seq")
    is_exit = (F.col("record_type") == "task") & (F.col("task_kind") == "exit")
    seen = F.col("record_type") == "sample"
    last_exit = F.last(F.when(is_exit, F.col("seq")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    last_seen = F.last(F.when(seen, F.col("seq")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    counts = is_exit & F.coalesce(last_seen > F.coalesce(last_exit, F.lit(-1).cast("long")), F.lit(False))
    rows = records.withColumn("counts", counts.cast("int"))
    generation = F.coalesce(F.sum("counts").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.withColumn("generation", generation).withColumn("thread", thread_name(F.col("tid"), F.col("generation"))).drop("counts")


def coverage_segments(points: DataFrame) -> DataFrame:
    """(thread, start_ns, end_ns): contiguous history (WIN4), cut where ``hole`` is true.

    ``points`` is (thread, seq, time_ns, hole).
    """
    order = Window.partitionBy("thread").orderBy("seq")
    rows = points.withColumn("segment", F.sum(F.col("hole").cast("int")).over(order))
    out = rows.groupBy("thread", "segment").agg(F.min("time_ns").alias("start_ns"), F.max("time_ns").alias("end_ns"))
    return out.drop("segment")


def time_regressions(points: DataFrame) -> DataFrame:
    """Records whose time lies before the one before them on their thread (WIN6)."""
    order = Window.partitionBy("thread").orderBy("seq")
    rows = points.withColumn("previous_ns", F.lag("time_ns").over(order))
    return rows.filter("time_ns < previous_ns").select("thread", "seq", "previous_ns", "time_ns")


def first_times(samples: DataFrame) -> DataFrame:
    """(cpu, first_ns): the first time in stream order on each cpu (AGG17), foreign samples included."""
    known = samples.filter("record_type = 'sample' and time_ns is not null and cpu is not null")
    return known.groupBy("cpu").agg(F.min_by("time_ns", "seq").alias("first_ns"))


def thread_lifetimes(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each thread (AGG8): first and last time, covered time, the first segments.

    The listed segments are picked by rank before they are gathered, so a thread
    with very many costs no more than one with a few.
    """
    ranked = segments.withColumn("k", F.row_number().over(Window.partitionBy("thread").orderBy("start_ns", "end_ns")))
    sums = segments.groupBy("thread").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("covered_ns"), F.count(F.lit(1)).alias("segment_count"))
    listed = ranked.filter(F.col("k") <= LISTED_SEGMENTS).groupBy("thread").agg(F.array_sort(F.collect_list(F.struct(F.col("start_ns").alias("start"), F.col("end_ns").alias("end")))).alias("segments"))
    return counts.join(sums, "thread", "left").join(listed, "thread", "left")


def summary(threads: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """One row (AGG11, AGG12): covered range, duration, table counts, the busiest threads."""
    whole = threads.agg(F.min("start_ns").alias("covered_start_ns"), F.max("end_ns").alias("covered_end_ns"), F.max("covered_ns").alias("max_thread_covered_ns"), F.count(F.lit(1)).alias("thread_count"))
    top = threads.orderBy(F.desc("branch_count"), "tid").limit(TOP_THREADS)
    names = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("branch_count")).alias("n"), "tid", "thread"))), lambda t: t["thread"]).alias("top_threads"))
    out = whole.join(F.broadcast(names))  # one row each
    for name, table in counts.items():
        out = out.join(F.broadcast(table.agg(F.count(F.lit(1)).alias(name))))
    return out.withColumn("duration_ns", F.col("covered_end_ns") - F.col("covered_start_ns"))


def gaps_by_kind(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def least_step(samples: DataFrame) -> DataFrame:
    """One row, min_time_step_ns: the least forward step between two times of a thread, null without any.

    ``samples`` is (part, pid, tid, seq, time_ns) in ranges of the stream: steps
    within a range by a window, over borders by one row a range and thread.
    """
    rows = samples.filter("time_ns is not null")
    inner = rows.select((F.col("time_ns") - F.lag("time_ns").over(Window.partitionBy("part", "pid", "tid").orderBy("seq"))).alias("step"))
    borders = rows.groupBy("part", "pid", "tid").agg(F.min_by("time_ns", "seq").alias("first"), F.max_by("time_ns", "seq").alias("last"))
    outer = borders.select((F.col("first") - F.lag("last").over(Window.partitionBy("pid", "tid").orderBy("part"))).alias("step"))
    return inner.unionByName(outer).agg(F.min(F.when(F.col("step") > 0, F.col("step"))).alias("min_time_step_ns"))


def quality_counters(spans: DataFrame, gaps: DataFrame, samples: DataFrame, records: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """One row of counters (AGG10).

    ``spans`` carry ``mismatch``; ``samples`` is what :func:`least_step` takes;
    ``foreign`` counts samples of other processes by pid.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    parts = [
        spans.agg(F.count_if(F.col("completeness") != "complete").alias("incomplete_spans"), F.count_if("mismatch").alias("unwind_mismatches")),
        gaps.agg(F.count(F.lit(1)).alias("gaps"), kind("decoder_error").alias("decoder_errors"), kind("missing_image").alias("missing_images"), kind("ring_truncation").alias("ring_holes")),
        records.agg(F.count_if(F.col("record_type") == "lost").alias("lost_records"), F.count_if(F.col("record_type") == "sample").alias("samples"), F.count_if((F.col("record_type") == "sample") & F.col("time_ns").isNull()).alias("unknown_times")),
        least_step(samples),
        spans.limit(0).agg(F.count(F.lit(1)).alias("foreign_samples"), F.count(F.lit(1)).alias("foreign_pids")) if foreign is None else foreign.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("foreign_samples"), F.count("pid").alias("foreign_pids")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # a row each
    return out


def quality(spans: DataFrame, gaps: DataFrame, samples: DataFrame, records: DataFrame, foreign: DataFrame | None = None) -> dict:
    """The quality object of an analysis (Q2): counters, gaps by kind, and what they mean."""
    n = quality_counters(spans, gaps, samples, records, foreign).first().asDict()
    says = {
        "lost_records": "records of lost data; history may be cut short",
        "foreign_samples": "samples of other processes left out",
        "ring_holes": "moves between cpus whose history does not reach back; threads list what is covered",
        "unknown_times": "samples without a time",
        "unwind_mismatches": "returns that landed outside of the caller known",
    }
    notes = [f"{n[k]} {text}" for k, text in says.items() if n[k]]
    notes.append("times advance in unknown steps" if n["min_time_step_ns"] is None else f"times advance in steps of {n['min_time_step_ns']} ns at least")
    return {
        "timing": "decoder_estimate",
        "gap_count": n["gaps"],
        "incomplete_span_count": n["incomplete_spans"],
        "missing_image_count": n["missing_images"],
        "decoder_error_count": n["decoder_errors"],
        "ring_truncation": n["ring_holes"] > 0,
        "undecodable_prefix": False,
        "notes": notes,
        "gaps_by_kind": {r["kind"]: r["n"] for r in gaps_by_kind(gaps).collect()},
        "counters": n,
    }


def trigger_location(records: DataFrame, address: int) -> DataFrame:
    """(traps, last_ns): traps that leave an address, and the time of the last (AGG16)."""
    return records.filter((F.col("from_ip") == address) & F.col("interrupt")).agg(F.count(F.lit(1)).alias("traps"), F.max_by("time_ns", F.struct("time_ns", "seq")).alias("last_ns"))


def rebase(table: DataFrame, origin_ns: int, *columns: str) -> DataFrame:
    """Absolute times to times since the origin, never below 0 (PRJ17); unknown ones stay unknown."""
    return table.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0).cast("long"), F.col(c) - origin_ns)) for c in columns})


def tail_window(records: DataFrame, window_ns: int) -> DataFrame:
    """The records of the last stretch of time (STR4); those without a time stay."""
    last = F.broadcast(records.agg(F.max("time_ns").alias("last_ns")))
    return records.join(last).filter(F.col("time_ns").isNull() | (F.col("time_ns") >= F.col("last_ns") - window_ns)).drop("last_ns")
