"""From records to a published analysis: the whole way in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.errors import TraceError
from pathglass.functions.scalars import thread_name
from pathglass.operators import code, process, reconstruct, records as stream
from pathglass.operators.call_paths import row_rank
from pathglass.operators.instructions import instruction_rows
from pathglass.operators.locate import Images, locate, mappings_of
from pathglass.plans.store import Store
from pathglass.schemas import EVENTS, GAPS, LOCATIONS, MAPPINGS, SPANS, THREADS
from pathglass.storage import cut

IR_VERSION = 1
#: Parts of each stream that are tried, newest last, until the budget holds them (STR4).
TAILS = (1, 4, 16, 64)


def within_budget(records: DataFrame, budget: int | None) -> tuple[DataFrame, int]:
    """(records, part): the newest 1, 1/4, 1/16 or 1/64 of each stream, the largest of at most ``budget`` samples.

    Side records stay whole. One pass counts all the parts.
    """
    if budget is None:
        return records, 1
    spans = records.groupBy("stream").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    # One row for each stream.
    rows = records.join(F.broadcast(spans), "stream")
    sample = F.col("record_type") == "sample"
    newest = lambda part: F.col("seq") > F.col("high") - F.ceil((F.col("high") - F.col("low") + 1) / part)
    counts = rows.agg(*(F.count_if(sample & newest(p)).alias(f"p{p}") for p in TAILS)).first()
    part = next((p for p in TAILS if counts[f"p{p}"] <= budget), None)
    if part is None:
        raise TraceError("LIMIT_EXCEEDED", f"even 1/{TAILS[-1]} of the history has more than {budget} samples")
    return rows.filter(~sample | newest(part)).drop("low", "high"), part


def rebased(table: DataFrame, origin_ns: int, *columns: str) -> DataFrame:
    """Times since the origin; one that lies before it is an error, not a zero (PRJ17)."""
    early = F.raise_error(F.lit(f"a time lies before the origin {origin_ns}"))
    return table.withColumns({c: F.when(F.col(c) < origin_ns, early).otherwise(F.col(c) - origin_ns) for c in columns})


def final_names(prepared: DataFrame) -> DataFrame:
    """(pid, tid, thread): the name that a task's inline rows go by, that of its last generation, or of the first if the last has ended."""
    leaves = F.col("record_type") == "task"
    last = prepared.groupBy("pid", "tid").agg(F.max_by(leaves, "seq").alias("ended"), F.max(F.when(F.col("record_type") == "sample", F.col("generation"))).alias("latest"))
    return last.filter("latest is not null").select("pid", "tid", F.when(F.col("ended"), thread_name(F.col("tid"), F.lit(0))).otherwise(thread_name(F.col("tid"), F.col("latest"))).alias("thread"))


def analyze(store: Store, analysis: str, records: DataFrame, images: Images, root_pid: int | None = None, target: str | None = None, budget: int | None = None, manifest: dict | None = None) -> dict:
    """Publish the calls, and the instructions if there are any, of RECORDS as an analysis; returns its manifest.

    Records of other processes are left out if a root process or a target is given.
    Several streams are merged by time. Where the images' contents are known, blocks
    of code are charged to inline chains.
    """
    spark = store.spark
    records, part = within_budget(records, budget)
    records = cut(reconstruct.with_event_ids(records), "numbered")
    foreign = None
    if root_pid is not None or target is not None:
        kept, foreign = process.live(records, process.traced(records, root_pid, target))
        # Foreign samples still say when a cpu's history begins.
        records, everything = cut(kept, "live"), records
    else:
        everything = records
    mappings = cut(mappings_of(records), "mappings")
    transfers = records.filter("record_type = 'sample' and (event is null or event <> 'instructions')")
    ends = transfers.select((2 * F.col("event_id")).alias("id"), "pid", F.col("ip"), "seq").unionByName(transfers.select((2 * F.col("event_id") + 1).alias("id"), "pid", F.col("addr").alias("ip"), "seq")).filter("ip is not null")
    at = cut(locate(ends, mappings, images).join(ends.select("id", "ip"), "id"), "ends")
    places = at.filter("image_id is not null").groupBy("image_id", "image_offset", "function").agg(F.min("ip").alias("virt_ip"), F.min("inlined").alias("inlined"), F.min(F.get("frames", F.lit(0))).alias("frame"))
    places = cut(row_rank(places, "image_id", "image_offset", "function").withColumnRenamed("ord", "location"), "places")
    at = at.join(places.select("image_id", "image_offset", F.col("function").alias("f"), "location"), ["image_id", "image_offset"], "left").filter("f <=> function or location is null")
    side = lambda bit, name: at.filter(F.col("id") % 2 == bit).select(F.shiftright("id", 1).alias("event_id"), F.col("function").alias(f"{name}_fn"), F.xxhash64("path").alias(f"{name}_map"), F.col("location").alias(f"{name}_location"))
    rows = reconstruct.classify(records.filter("event is null or event <> 'instructions'")).join(side(0, "from"), "event_id", "left").join(side(1, "to"), "event_id", "left")
    rows = cut(rows, "located")

    whole = cut(reconstruct.prepare(rows, everything, mark=True), "prepared")
    prepared = whole.filter("not moot")
    spans, gaps = (cut(t, n) for t, n in zip(reconstruct.reconstruct(rows, counted=True, prepared=prepared), ("spans", "gaps"), strict=True))
    events = reconstruct.retained_of(prepared).join(rows.select(F.col("event_id").alias("id"), "from_location", "to_location"), "id")
    named = whole.filter("record_type = 'sample'").select("thread", "pid", "tid", "seq", "part", "time_ns", "event_id")
    origin = named.agg(F.min("time_ns")).first()[0] or 0

    holes = gaps.filter("kind = 'ring_truncation'").select("thread", F.col("event").alias("event_id"), F.lit(True).alias("hole"))
    points = named.filter("time_ns is not null").join(holes, ["thread", "event_id"], "left").withColumn("hole", F.coalesce("hole", F.lit(False)))
    segments = stream.coverage_segments(points)
    counts = named.groupBy("thread").agg(F.min("pid").alias("pid"), F.min("tid").alias("tid"), F.count(F.lit(1)).alias("branch_count"))
    for name, table in (("event_count", events), ("span_count", spans), ("gap_count", gaps)):
        counts = counts.join(table.groupBy("thread").agg(F.count(F.lit(1)).alias(name)), "thread", "left").fillna(0, [name])
    comm = records.filter("record_type = 'task' and comm is not null").groupBy("pid", "tid").agg(F.max_by("comm", "seq").alias("comm"))
    threads = stream.thread_lifetimes(segments, counts).join(comm, ["pid", "tid"], "left").withColumnRenamed("thread", "id")
    threads = rebased(threads, origin, "start_ns", "end_ns").withColumn("segments", F.transform("segments", lambda s: F.struct((s["start"] - origin).alias("start"), (s["end"] - origin).alias("end"))))

    quality = stream.quality(spans, gaps, named, records, foreign)
    if part > 1:
        quality["notes"].append(f"only the newest 1/{part} of each stream fits the budget")
    as_schema = lambda df, schema: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    located = places.select(F.col("location").alias("id"), "image_id", "image_offset", "virt_ip", "function", F.col("frame.file").alias("file"), F.col("frame.line").cast("long").alias("line"), "inlined")
    tables = {
        "events": as_schema(rebased(events, origin, "time_ns"), EVENTS),
        "spans": as_schema(rebased(spans, origin, "start_ns", "end_ns"), SPANS),
        "gaps": as_schema(stream.rebase(gaps, origin, "start_ns", "end_ns"), GAPS),
        "threads": as_schema(threads, THREADS),
        "functions": images.functions,
        "locations": as_schema(located, LOCATIONS),
        "mappings": as_schema(stream.rebase(mappings, origin, "valid_from"), MAPPINGS),
        "images": images.images,
        "segments": images.segments,
        "inline_ranges": images.inline,
    }
    covered = named.agg(F.max("time_ns")).first()[0]
    out = {"detail": "calls", "ir_version": IR_VERSION, "decode_mode": "full", "origin_ns": origin, "covered_start_ns": 0, "covered_end_ns": (covered or origin) - origin, "quality": quality} | (manifest or {})
    if images.code is not None:
        tables["code"] = images.code
        tables["inline_rows"] = code.inline_rows(rows, mappings, images, final_names(whole))
    if not records.filter("record_type = 'sample' and event = 'instructions'").isEmpty():
        ran = instruction_rows(records, images, mappings)
        tables["instructions"] = rebased(ran, origin, "time_ns") if origin else ran
        out["detail"] = (manifest or {}).get("detail", "calls")
    store.publish(analysis, tables, out)
    return store.manifest(analysis)


def overlay(instructions: dict, calls: dict) -> dict:
    """The quality of an instruction analysis with what only the calls analysis knows (AGG19)."""
    return instructions | {k: calls[k] for k in ("ring_truncation", "gap_count", "gaps_by_kind") if k in calls}

