"""The registered queries over the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathglass.functions import scalars
from pathglass.functions.flags import BOUNDARIES, boundary, flag_set, flow_kind
from pathglass.operators import branches, call_paths, code, compare, hotpaths, locate, process, reconstruct, records, symbols
from pathglass.operators.instructions import instruction_rows as rows_of_instructions
from pathglass.operators.quantiles import nearest_ranks
from pathglass.operators.self_time import self_times
from pathglass.operators.timeline import selected, timeline, timeline_order
from pathglass.sources import star
from pathglass.storage import cut, shared_dir, stored
from pathglass.streaming.call_stacks import run_to_end, stream_stacks

#: A window and an instant inside the star tables' span of time.
WINDOW = (50_000_000_000_000_000, 150_000_000_000_000_000)
INSTANT = 100_000_000_000_000_000
PAGE = 50
#: An instant inside the events' span of time.
DEEP_INSTANT = 1_706_000_000_000_000_000


def _spans(spark, sf):
    return star.spans(spark, sf), star.functions(spark, sf)


def _derived(spark, sf):
    """The spans as a written table, as a store holds them: written once, and anew when the star tables change."""
    return stored(spark, ("spans", sf), lambda: star.spans(spark, sf), [f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "part")]), star.functions(spark, sf)


def hotpaths_function(spark, sf):
    return hotpaths.hotpaths(*_derived(spark, sf))


def _ranked(rows: DataFrame, sort: str) -> DataFrame:
    return call_paths.row_rank(rows, *hotpaths.sort_order(sort)).select("ord", "path", "observed_entries", "inclusive_sum_ns", "self_sum_ns")


def hotpaths_self_time(spark, sf):
    return _ranked(hotpaths.hotpaths(*_derived(spark, sf)), "self_time")


def hotpaths_calls(spark, sf):
    return _ranked(hotpaths.hotpaths(*_derived(spark, sf)), "calls")


def hotpaths_path(spark, sf):
    return hotpaths.hotpaths(*_derived(spark, sf), group="path")


def hotpaths_path_depth1(spark, sf):
    return hotpaths.hotpaths(*_derived(spark, sf), group="path", depth=1)


def hotpaths_window(spark, sf):
    return hotpaths.hotpaths(*_derived(spark, sf), start_ns=WINDOW[0], end_ns=WINDOW[1], contains="part::")


def hotpaths_inline(spark, sf):
    return hotpaths.hotpaths_inline(star.inline_rows(spark, sf), star.functions(spark, sf))


def hotpaths_totals(spark, sf):
    return hotpaths.totals(hotpaths.hotpaths(*_derived(spark, sf)))


def self_time_per_span(spark, sf):
    return self_times(_derived(spark, sf)[0])


def quantiles(spark, sf):
    lines = star.star(spark, sf, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))
    return nearest_ranks(lines, "l_returnflag", (50, 95, 99))


def timeline_all(spark, sf):
    return timeline(*_spans(spark, sf), start_ns=WINDOW[0], end_ns=WINDOW[1])


def timeline_filtered(spark, sf):
    return timeline(*_spans(spark, sf), start_ns=WINDOW[0], end_ns=WINDOW[1], min_duration_ns=5_000_000, contains="Brand#1")


def timeline_page2(spark, sf):
    rows = timeline(*_spans(spark, sf), start_ns=WINDOW[0], end_ns=WINDOW[1]).orderBy(*timeline_order())
    return rows.offset(PAGE).limit(PAGE)


def at_instant(spark, sf):
    rows = call_paths.at_instant(*_derived(spark, sf), INSTANT)
    return rows.withColumn("stack", F.array_join("stack", " > "))


def deep_paths(spark, sf):
    """Paths and depths of spans deeper than a path shows."""
    rows = call_paths.call_paths(star.chains(spark, sf), star.chain_functions(spark))
    return rows.select("id", "depth", "path")


def deep_at_instant(spark, sf):
    rows = call_paths.at_instant(star.chains(spark, sf), star.chain_functions(spark), DEEP_INSTANT)
    return rows.withColumn("stack", F.array_join("stack", " > "))


def timeline_whole(spark, sf):
    return timeline(*_spans(spark, sf))


def inline_profile_whole(spark, sf):
    return branches.inline_profile(star.instructions(spark, sf))


def _by_year(spark, sf, low: int, high: int):
    year = F.year(F.timestamp_micros(F.floor((F.col("start_ns") + star.ORIGIN_NS) / 1000).cast("long")))
    spans, functions = _derived(spark, sf)
    return hotpaths.hotpaths(spans.filter(year.between(low, high)), functions, own=False)  # a comparison looks at no self times


def compare_function(spark, sf):
    pairs = [("order::1-URGENT", "order::2-HIGH"), ("Brand#7", "no such function")]
    return compare.compare_hotpaths(_by_year(spark, sf, 1990, 1996), _by_year(spark, sf, 1997, 2010), pairs)


def compare_ambiguous(spark, sf):
    """Functions renamed so that some stems stand for two rows."""
    renamed = lambda df, salt: df.withColumn("path", F.when(F.col("path").rlike("Brand#1[0-9]$"), F.concat(F.regexp_replace("path", "#.*$", ""), F.lit(f"::h{salt}"), F.lpad(F.regexp_extract("path", "([0-9]+)$", 1), 6, "0"))).otherwise(F.concat("path", F.lit(f"::h{salt}aaaaaa"))))
    return compare.compare_hotpaths(renamed(_by_year(spark, sf, 1990, 1996), "ab"), renamed(_by_year(spark, sf, 1997, 2010), "cd"))


def branches_sites(spark, sf):
    """Every seventh instruction is missing, so that some indirect branches have no next one."""
    rows = branches.branch_sites(star.instructions(spark, sf).filter("id % 7 <> 3"))
    return rows.withColumn("indirect_targets", F.array_join("indirect_targets", " "))


def branches_order(spark, sf):
    """The order of the branches page, as a rank: a row for each site."""
    return call_paths.row_rank(branches.branch_sites(star.instructions(spark, sf)), *branches.site_order()).select("ord", "site", "taken_fraction")


def inline_profile(spark, sf):
    return branches.inline_profile(selected(star.instructions(spark, sf), start_ns=1_704_500_000_000_000_000, end_ns=1_706_000_000_000_000_000))


def instruction_outcome(spark, sf):
    rows = star.records(spark, sf)
    samples = rows.select("pid", "tid", "seq", (F.col("flags") == "async").alias("is_error"), "ip", F.when(F.col("flags") == "jcc", "conditional").otherwise("other").alias("kind"), F.col("addr").alias("branch_target"), (F.col("ip") + 512).alias("fallthrough"))
    samples = samples.withColumn("ip", F.col("ip") - F.col("ip") % 256)
    return branches.outcomes(samples).select("seq", "tid", "sequence", "kind", "outcome")


def straight_blocks(spark, sf):
    rows = star.records(spark, sf).select(F.concat(F.lit("t_"), F.col("tid").cast("string")).alias("thread"), "seq", "time_ns", F.col("ip").alias("from_ip"), F.col("addr").alias("to_ip"), F.col("flags").isin("async", "tr end call").alias("breaks"))
    blocks = branches.straight_blocks(rows).withColumn("function", F.shiftright("start", 8)).withColumn("chain", F.array(F.lit("all"))).withColumn("instructions", F.lit(1).cast("long") + (F.col("end") - F.col("start")).cast("long"))
    return branches.attribute_blocks(blocks).withColumn("chain", F.array_join("chain", " > "))


def _points(spark, sf):
    rows = star.records(spark, sf)
    return rows.select(F.concat(F.lit("t_"), F.col("tid").cast("string")).alias("thread"), "seq", "time_ns", F.col("flags").startswith("tr strt").alias("hole"))


def coverage_segments(spark, sf):
    return records.coverage_segments(_points(spark, sf))


def threads_summary(spark, sf):
    counts = _points(spark, sf).groupBy("thread").agg(F.count(F.lit(1)).alias("branch_count"))
    rows = records.thread_lifetimes(records.coverage_segments(_points(spark, sf)), counts)
    listed = F.array_join(F.transform("segments", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
    return rows.withColumn("segments", listed)


def summary(spark, sf):
    counts = _points(spark, sf).groupBy("thread").agg(F.count(F.lit(1)).alias("branch_count"), F.substring(F.min("thread"), 3, 20).cast("long").alias("tid"))
    threads = records.thread_lifetimes(records.coverage_segments(_points(spark, sf)), counts)
    out = records.summary(threads, {"span_count": star.spans(spark, sf), "function_count": star.functions(spark, sf)})
    return out.withColumn("top_threads", F.array_join("top_threads", " "))


def gaps_by_kind(spark, sf):
    """Users' quiet times as gaps: under a minute, an hour, or longer."""
    order = Window.partitionBy("tid").orderBy("seq")
    rows = star.records(spark, sf).withColumn("quiet", F.col("time_ns") - F.lag("time_ns").over(order)).filter("quiet is not null")
    kind = F.when(F.col("quiet") < 60_000_000_000, "trace_boundary").when(F.col("quiet") < 3_600_000_000_000, "unknown").otherwise("ring_truncation")
    return records.gaps_by_kind(rows.select(kind.alias("kind")))


def quality_counters(spark, sf):
    order = Window.partitionBy("tid").orderBy("seq")
    rows = star.records(spark, sf).withColumn("step", F.col("time_ns") - F.lag("time_ns").over(order))
    spans = star.spans(spark, sf).agg(F.count_if(F.col("completeness") != "complete").alias("incomplete_spans"))
    out = rows.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("flags") == "async").alias("interruptions"), F.count_if(F.col("time_ns").isNull()).alias("unknown_times"), F.min(F.when(F.col("step") > 0, F.col("step"))).alias("min_time_step_ns"))
    return out.join(F.broadcast(spans))  # a row each


def first_cpu_times(spark, sf):
    return records.first_times(star.records(spark, sf))


def time_regressions(spark, sf):
    """The stream ordered by value, so that time does jump back."""
    e = star.star(spark, sf, "events")
    points = e.select(F.concat(F.lit("t_"), F.col("user_id").cast("string")).alias("thread"), F.round(F.col("value") * 1000).cast("long").alias("v"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"))
    points = points.withColumn("seq", F.col("v") * 1_000_000 + F.col("event_id"))
    return records.time_regressions(points.select("thread", "seq", "time_ns"))


def trigger_location(spark, sf):
    rows = star.records(spark, sf).select(F.col("ip").alias("from_ip"), (F.col("flags") == "async").alias("interrupt"), "time_ns", "seq")
    return records.trigger_location(rows, 4096 + 256)


def tail_window(spark, sf):
    rows = star.records(spark, sf).select("seq", "tid", "time_ns")
    return records.tail_window(rows, 24 * 3_600_000_000_000)


def _ranges(spark, sf):
    part = star.star(spark, sf, "part")
    start = 0x400000 + F.col("p_partkey") * 64
    return part.select(F.lit("image").alias("image_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), start.alias("start"), (start + F.col("p_size")).alias("end"))


def _probes(spark, sf):
    return star.star(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("image").alias("image_id"), (0x400000 + F.pmod(F.col("event_id") * 37, F.lit(100_000))).alias("address"))


def symbolize_asof(spark, sf):
    return symbols.symbolize(_probes(spark, sf), _ranges(spark, sf)).select("id", "address", "function", "symbol", "offset")


def map_range_join(spark, sf):
    part = star.star(spark, sf, "part")
    start = 0x400000 + F.col("p_partkey") * 4096
    maps = part.select((F.col("p_partkey") % 3).cast("int").alias("pid"), start.alias("start"), (start + F.col("p_size") * 1024).alias("end"), F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("generation"), F.col("p_name").alias("path"))
    samples = star.star(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("pid"), (0x400000 + F.pmod(F.col("event_id") * 7919, F.lit(9_000_000))).alias("ip"))
    return symbols.map_addresses(samples, maps).select("id", "pid", "ip", "map_start", "generation", "path")


def inline_frames(spark, sf):
    part = star.star(spark, sf, "part")
    lo = 0x400000 + F.col("p_partkey") * 32
    ranges = part.select(F.lit("image").alias("image_id"), lo.alias("lo"), (lo + F.col("p_size") * 4).alias("hi"), F.array(F.struct(F.col("p_brand").alias("function"), F.lit("a.c").alias("file"), F.col("p_size").alias("line"))).alias("frames"))
    rows = symbols.inline_frames(_probes(spark, sf).withColumn("symbol", F.lit("Brand#7")), ranges)
    return rows.select("id", "address", "inlined", F.get(F.col("frames"), F.lit(0))["line"].alias("line"))


def process_tree(spark, sf):
    """Regions fork nations, nations customers, customers orders."""
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation, customer, orders = (star.star(spark, sf, t) for t in ("nation", "customer", "orders"))
    forks = nation.select(text("r", "n_regionkey").alias("parent"), text("n", "n_nationkey").alias("child"))
    forks = forks.unionByName(customer.select(text("n", "c_nationkey").alias("parent"), text("c", "c_custkey").alias("child")))
    forks = forks.unionByName(orders.select(text("c", "o_custkey").alias("parent"), text("o", "o_orderkey").alias("child")))
    return records.process_tree(forks, spark.createDataFrame([("r1",), ("r3",)], "pid string"))


def live_foreign(spark, sf):
    """Samples of the traced processes' threads by kind of flag; the others are only counted."""
    tree = spark.createDataFrame([(k,) for k in range(0, 100, 3)], "pid int")
    live, foreign = records.live_samples(star.records(spark, sf).withColumn("pid", F.col("tid")), tree)
    rows = live.groupBy("flags").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(foreign.select(F.lit("foreign").alias("flags"), F.col("foreign").alias("n")))


def merge_streams(spark, sf):
    orders = star.star(spark, sf, "orders").select(F.lit("sample").alias("record_type"), F.col("o_orderkey").alias("seq"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("time_ns"))
    lines = star.star(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, "mmap").otherwise("sample").alias("record_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("time_ns"))
    rows = records.merge_streams([orders, lines])
    return rows.groupBy("stream", F.floor(F.col("at") / 86_400_000_000).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def thread_generations(spark, sf):
    """Purchases as exits: a user's thread ends with each."""
    rows = star.records(spark, sf).withColumn("record_type", F.when(F.col("flags") == "return", "task").otherwise(F.col("record_type"))).withColumn("task_kind", F.when(F.col("flags") == "return", "exit"))
    return records.generations(rows).select("seq", "generation", "thread")


def flags_classify(spark, sf):
    rows = star.records(spark, sf).withColumn("set", flag_set(F.col("flags")))
    return rows.select("seq", flow_kind(F.col("set")).alias("kind"), *(c.alias(n) for n, c in boundary(F.col("set")).items()))


def perf_time_parse(spark, sf):
    e = star.star(spark, sf, "events")
    text = F.concat(F.col("event_id").cast("string"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    return e.select("event_id", scalars.trace_time_ns(text).alias("ns"))


def linkage_stem(spark, sf):
    part = star.star(spark, sf, "part")
    name = F.concat("p_name", F.lit("::h"), F.lower(F.hex(F.col("p_partkey") * 1_000_003)))
    return part.select("p_partkey", name.alias("name"), scalars.linkage_stem(name).alias("stem"))


def address_hex(spark, sf):
    orders = star.star(spark, sf, "orders")
    text = scalars.address_hex(F.col("o_orderkey") * 4099)
    return orders.select("o_orderkey", text.alias("address"), scalars.parse_address(text).alias("parsed"))


def namespaced_id(spark, sf):
    orders = star.star(spark, sf, "orders")
    text = scalars.namespaced_id(F.concat(F.lit("a:"), "o_orderstatus"), "sp", F.col("o_orderkey"))
    parts = scalars.split_namespaced_id(text)
    return orders.select(text.alias("id"), parts["analysis"].alias("analysis"), parts["kind"].alias("kind"), parts["number"].alias("number"))


def cache_key(spark, sf):
    part = star.star(spark, sf, "part")
    return part.select("p_partkey", scalars.content_key(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("key"))


def with_functions(records: DataFrame) -> DataFrame:
    """Records classified, with functions: one for each 256 bytes, one of them unknown."""
    nothing = {"task_kind": "string", "code": "int", "message": "string"}
    rows = reconstruct.classify(records.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items() if c not in records.columns}))
    of = lambda c: F.nullif(F.shiftright(c, 8) - 15, F.lit(7).cast("long"))
    return rows.withColumn("from_fn", of(F.col("ip"))).withColumn("to_fn", of(F.col("addr")))


def _symbolic(spark, sf):
    return with_functions(star.records(spark, sf))


def reconstruct_spans(spark, sf):
    return reconstruct.reconstruct(_symbolic(spark, sf))[0]


def reconstruct_gaps(spark, sf):
    return reconstruct.reconstruct(_symbolic(spark, sf))[1]


def stream_reconstruct(spark, sf):
    """The event stream as a stream, its stacks in state; spans and gaps as they close."""
    events = spark.readStream.schema(star.star(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")  # a pattern names a file or a folder
    rows = with_functions(star.records_of(events)).withColumn("cpu_first_ns", F.lit(0).cast("long"))
    return run_to_end(stream_stacks(rows), f"{shared_dir(spark)}/pathglass/stream-{uuid.uuid4().hex}")


def every_kind_spans(spark, sf):
    """Calls across interrupts, system calls, errors, exits and steps back in time."""
    return reconstruct.reconstruct(with_functions(star.records_of_every_kind(spark, sf)))[0]


def every_kind_gaps(spark, sf):
    return reconstruct.reconstruct(with_functions(star.records_of_every_kind(spark, sf)))[1]


def live_records(spark, sf):
    """What is kept of four processes if the first is traced, with what it forks."""
    rows = cut(star.records_of_processes(spark, sf), "processes")
    kept, _ = process.live(rows, process.traced(rows, root_pid=1))
    return kept.select("seq", "record_type", "pid", "tid")


def foreign_samples(spark, sf):
    rows = cut(star.records_of_processes(spark, sf), "processes")
    return process.live(rows, process.traced(rows, root_pid=1))[1]


def merged_streams_spans(spark, sf):
    """Calls of two overlapping streams with steps back in time, merged."""
    return reconstruct.reconstruct(with_functions(star.two_streams(spark, sf)))[0]


def merged_streams_gaps(spark, sf):
    return reconstruct.reconstruct(with_functions(star.two_streams(spark, sf)))[1]


def instruction_rows(spark, sf):
    mappings, images = star.code(spark)
    return rows_of_instructions(star.executed(spark, sf), images, mappings)


def instruction_rows_from_image(spark, sf):
    """Bytes stated or read from the image, across exits and errors with and without a task."""
    mappings, images = star.code_with_bytes(spark)
    return rows_of_instructions(star.executed_with_exits(spark, sf), images, mappings)


def inline_attribution(spark, sf):
    """Blocks of code between branches, counted in the image's bytes and charged to inline chains."""
    mappings, images = star.code_with_bytes(spark)
    # Half of the branches go into an inlined part of their block.
    rows = star.records(spark, sf).withColumn("addr", F.col("addr") + F.col("seq") % 2 * 4).withColumn("task_kind", F.lit(None).cast("string"))
    out = code.inline_rows(reconstruct.classify(reconstruct.with_event_ids(rows)), mappings, images)
    return out.withColumn("chain", F.array_join("chain", " > "))


def hotpaths_inline_attributed(spark, sf):
    mappings, images = star.code_with_bytes(spark)
    rows = star.records(spark, sf).withColumn("addr", F.col("addr") + F.col("seq") % 2 * 4).withColumn("task_kind", F.lit(None).cast("string"))
    rows = code.inline_rows(reconstruct.classify(reconstruct.with_event_ids(rows)), mappings, images)
    return hotpaths.hotpaths_inline(rows, images.functions.select("id", "name")).select("path", "observed_entries", "self_sum_ns", "instructions")


def located_instructions(spark, sf):
    """By image and function: addresses found, their range and the frames' lines."""
    mappings, images = star.code(spark)
    rows = star.executed(spark, sf)
    at = locate.locate(rows.select(F.col("seq").alias("id"), "pid", "ip", "seq"), mappings, images)
    return at.groupBy("path", "image_id", "symbol", "inlined").agg(F.count(F.lit(1)).alias("n"), F.min("image_offset").alias("low"), F.max("image_offset").alias("high"), F.max(F.get("frames", F.lit(0))["line"]).alias("line"))


def reconstruct_quality(spark, sf):
    """The counters of the reconstructed event stream."""
    rows = cut(reconstruct.with_event_ids(_symbolic(spark, sf)), "numbered")
    spans, gaps = reconstruct.reconstruct(rows, counted=True)
    return records.quality_counters(spans, gaps, rows, rows)


def gaps_of_stream(spark, sf):
    return records.gaps_by_kind(reconstruct.reconstruct(_symbolic(spark, sf))[1])


def retained_events(spark, sf):
    return reconstruct.retained_events(_symbolic(spark, sf))


QUERIES = {
    "hotpaths_function": hotpaths_function,
    "hotpaths_self_time": hotpaths_self_time,
    "hotpaths_calls": hotpaths_calls,
    "hotpaths_path": hotpaths_path,
    "hotpaths_path_depth1": hotpaths_path_depth1,
    "hotpaths_window": hotpaths_window,
    "hotpaths_inline": hotpaths_inline,
    "hotpaths_totals": hotpaths_totals,
    "self_time_per_span": self_time_per_span,
    "nearest_rank_quantiles": quantiles,
    "timeline": timeline_whole,
    "timeline_window": timeline_all,
    "timeline_filtered": timeline_filtered,
    "timeline_page2": timeline_page2,
    "at_instant": at_instant,
    "deep_paths": deep_paths,
    "deep_at_instant": deep_at_instant,
    "compare_function": compare_function,
    "compare_ambiguous": compare_ambiguous,
    "branches": branches_sites,
    "branches_order": branches_order,
    "inline_profile": inline_profile_whole,
    "inline_profile_window": inline_profile,
    "instruction_outcome": instruction_outcome,
    "straight_blocks": straight_blocks,
    "coverage_segments": coverage_segments,
    "threads_summary": threads_summary,
    "summary": summary,
    "gaps_by_kind": gaps_by_kind,
    "quality_counters": quality_counters,
    "first_cpu_times": first_cpu_times,
    "time_regressions": time_regressions,
    "trigger_location": trigger_location,
    "tail_window": tail_window,
    "symbolize_asof": symbolize_asof,
    "map_range_join": map_range_join,
    "inline_frames": inline_frames,
    "process_tree": process_tree,
    "live_foreign": live_foreign,
    "merge_streams": merge_streams,
    "thread_generations": thread_generations,
    "flags_classify": flags_classify,
    "perf_time_parse": perf_time_parse,
    "linkage_stem": linkage_stem,
    "address_hex": address_hex,
    "namespaced_id": namespaced_id,
    "cache_key": cache_key,
    "reconstruct_spans": reconstruct_spans,
    "reconstruct_gaps": reconstruct_gaps,
    "reconstruct_quality": reconstruct_quality,
    "reconstruct_gaps_by_kind": gaps_of_stream,
    "instruction_rows": instruction_rows,
    "instruction_rows_from_image": instruction_rows_from_image,
    "inline_attribution": inline_attribution,
    "hotpaths_inline_attributed": hotpaths_inline_attributed,
    "every_kind_spans": every_kind_spans,
    "every_kind_gaps": every_kind_gaps,
    "live_records": live_records,
    "foreign_samples": foreign_samples,
    "merged_streams_spans": merged_streams_spans,
    "merged_streams_gaps": merged_streams_gaps,
    "located_instructions": located_instructions,
    "retained_events": retained_events,
    "stream_reconstruct": stream_reconstruct,
}
