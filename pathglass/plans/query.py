"""From a request to a page: one plan for each kind over the tables of an analysis."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.errors import invalid, not_found, not_ready
from pathglass.functions.scalars import address_hex, is_missing_image
from pathglass.operators import branches, call_paths, hotpaths, locate, records, symbols
from pathglass.operators.timeline import selected, timeline, timeline_order
from pathglass.plans.page import fit, take
from pathglass.plans.request import NEED_INSTRUCTIONS, Query
from pathglass.plans.store import Store

SCHEMA_VERSION = 1


def functions_of(store: Store, analysis: str) -> DataFrame:
    return store.read(analysis, "functions").select("id", F.coalesce("demangled", "name").alias("name"))


def images(snapshot: dict, spark) -> DataFrame:
    """The snapshot's images, and whether each is missing."""
    rows = [(i["path"], i.get("build_id")) for i in snapshot.get("images", [])]
    missing = F.array(*map(F.lit, snapshot.get("missing_images", []))).cast("array<string>")
    df = spark.createDataFrame(rows, "path string, build_id string")
    return df.withColumn("missing", is_missing_image(F.col("path"), missing))


def hints(query: Query, whole: DataFrame) -> list[str]:
    """Why a timeline or hot paths came out empty."""
    s, out = query.selection, []
    if s.thread is not None and whole.filter(F.col("thread") == s.thread).isEmpty():
        out.append(f"no spans on thread {s.thread}; summary lists the threads")
    if s.timed:
        out.append("no span fits the window; widen it")
    if query.contains is not None:
        out.append(f"no name contains {query.contains!r}; names are case-sensitive")
    if query.min_duration_ns is not None:
        out.append("no span lasts as long as the minimum; lower it")
    return out


def image_tables(store: Store, analysis: str) -> locate.Images:
    names = store.read(analysis, "functions").select("image_id", "id", F.coalesce("demangled", "name").alias("name"), "start", "end")
    return locate.Images(store.read(analysis, "images"), store.read(analysis, "segments"), names, store.read(analysis, "inline_ranges"), store.read(analysis, "code"))


def by_evidence(store: Store, analysis: str, evidence: str) -> DataFrame:
    """The locations that an evidence id leads to (JN11), the first at the top.

    A range of events gives the first of them with a location; a span its function,
    else its first event; a number that nothing else knows is tried as an instruction.
    """
    locations = store.read(analysis, "locations")
    m = re.fullmatch(r"(?:.*:)?(e|sp|f|l|g|i)?([0-9]+)(?:-e([0-9]+))?", evidence)
    if m is None or (m[3] and m[1] != "e"):
        raise invalid(f"not an evidence id: {evidence}")
    kind, low, high = m[1] or "e", int(m[2]), int(m[3] or m[2])
    of_function = lambda f: locations.filter(F.col("function") == f).orderBy("id")

    def of_events(low: int, high: int) -> DataFrame:
        events = store.read(analysis, "events").filter(F.col("id").between(low, high))
        if "from_location" in events.columns:
            at = events.withColumn("location", F.coalesce("from_location", "to_location")).filter("location is not null")
        else:  # a table of a store that names no locations
            at = events.join(locations.select(F.col("id").alias("location"), "virt_ip"), F.col("from_ip") == F.col("virt_ip"))
        first = at.orderBy(events["id"]).select("location").limit(1)
        return locations.join(F.broadcast(first), locations["id"] == first["location"]).drop("location")

    rows = locations.limit(0)
    if kind == "e":
        rows = of_events(low, high)
    elif kind == "f":
        rows = of_function(low)
    elif kind == "l":
        rows = locations.filter(F.col("id") == low)
    elif kind == "sp":
        span = store.read(analysis, "spans").filter(F.col("id") == low).first()
        if span is not None:
            rows = of_function(span["function"])
            if rows.isEmpty() and span["start_event"] is not None:
                rows = of_events(span["start_event"], span["start_event"])
    if rows.isEmpty() and kind != "g":
        ran = store.read(analysis, "instructions").filter((F.col("id") == low) & F.col("location").isNotNull()).select("location").limit(1)
        rows = locations.join(F.broadcast(ran), locations["id"] == ran["location"]).drop("location")
    return rows


def source(query: Query, store: Store, analysis: str) -> DataFrame:
    """Where something lies (Q10): by address, else location, function or evidence id."""
    if query.address is not None:
        maps = store.read(analysis, "mappings").withColumn("seq", F.lit(0).cast("long")).withColumn("any", F.lit(1))
        probe = store.spark.createDataFrame([(0, 1, query.address, 0)], "id long, any int, ip long, seq long")
        # Any task's mapping will do for an address alone.
        hit = symbols.map_addresses(probe, maps.select("any", "start", "end", "generation", "seq", "pgoff", "path", "build_id"), ("any",)).filter("path is not null")
        at = locate.locate(probe, maps.select("any", "start", "end", "generation", "seq", "pgoff", "path"), image_tables(store, analysis), ("any",))
        offset = F.col("ip") - F.col("map_start") + F.col("pgoff")
        rows = hit.select("id", address_hex(F.col("ip")).alias("address"), "path", offset.alias("file_offset"), "build_id").join(at.select("id", "image_id", "image_offset", "function", "symbol", "inlined", "frames"), "id", "left").drop("id")
    else:
        locations = store.read(analysis, "locations")
        if query.location_id is not None:
            rows = locations.filter(F.col("id") == query.location_id)
        elif query.function_id is not None:
            rows = locations.filter(F.col("function") == query.function_id)
        else:
            rows = by_evidence(store, analysis, query.evidence)
        rows = rows.select("id", "image_id", "image_offset", "function", "file", "line", "inlined").orderBy("id")
    if rows.isEmpty():
        raise not_found("nothing is known there")
    return rows


def call_site_names(rows: list[dict], store: Store, analysis: str, key: str = "id") -> None:
    """Adds to the rows of a page the innermost inlined function at their call sites (JN8); nothing beyond the page is looked up."""
    ids = [r[key] for r in rows]
    spans = store.read(analysis, "spans").filter(F.col("id").isin(ids) & F.col("call_site").isNotNull()) if ids else None
    if spans is None or spans.isEmpty():
        return
    threads = store.read(analysis, "threads").select(F.col("id").alias("thread"), "pid")
    maps = store.read(analysis, "mappings").withColumn("seq", F.lit(0).cast("long"))
    probes = spans.join(threads, "thread").select("id", "pid", F.col("call_site").alias("ip"), F.lit(0).cast("long").alias("seq"))
    found = {r["id"]: r["inlined"] for r in locate.locate(probes, maps, image_tables(store, analysis)).collect()}
    for r in rows:
        r["call_site_inline"] = found.get(r[key])


def run_query(store: Store, query: Query, analysis: str | None = None, snapshot: dict | None = None, report: DataFrame | None = None) -> dict:
    """The page that answers a request."""
    if (query.kind == "comparison") != (report is not None):
        raise invalid("comparisons read a report, other kinds an analysis")
    offset, limit = query.page()
    if report is not None:
        data, following = take(report, [F.asc("ord")], offset, limit)
        return fit({"schema_version": SCHEMA_VERSION, "kind": query.kind, "data": data, "next_cursor": following, "truncated": following is not None}, offset=offset)
    manifest = store.manifest(analysis) if analysis else store.default_analysis()
    name, s = manifest["id"], query.selection
    if query.kind in NEED_INSTRUCTIONS and "instructions" not in manifest["tables"]:
        raise not_ready("the analysis has no instructions")
    s.check_covered(manifest.get("covered_start_ns"), manifest.get("covered_end_ns"))
    totals, whole, order = None, None, None
    if query.kind in ("timeline", "hotpaths", "at_instant"):
        whole, names = store.read(name, "spans"), functions_of(store, name)
    if query.kind == "timeline":
        rows, order = timeline(whole, names, s.thread, s.start_ns, s.end_ns, query.min_duration_ns, query.contains), timeline_order(name)
    elif query.kind == "hotpaths":
        inline = query.group == "inline"
        if inline:
            if "inline_rows" not in manifest["tables"]:
                raise not_ready("the analysis has no inline rows")
            rows = hotpaths.hotpaths_inline(store.read(name, "inline_rows"), names, query.shown_depth(), s.thread, query.contains)
        else:
            rows = hotpaths.hotpaths(whole, names, query.group, query.shown_depth(), s.thread, query.contains, s.start_ns, s.end_ns)
        totals, order = hotpaths.totals(rows).first().asDict(), hotpaths.sort_order(query.sort, inline)
    elif query.kind == "at_instant":
        rows, order = call_paths.at_instant(whole, names, query.at_ns), [F.asc("thread")]
        rows = rows if s.thread is None else rows.filter(F.col("thread") == s.thread)
    elif query.kind in NEED_INSTRUCTIONS:
        kept = selected(store.read(name, "instructions"), s.thread, s.start_ns, s.end_ns)
        if query.kind == "instructions":
            rows, order = kept.withColumns({c: address_hex(F.col(c)) for c in ("virt_ip", "branch_target", "fallthrough")}), [F.asc("id")]
        elif query.kind == "branches":
            rows, order = branches.branch_sites(kept), branches.site_order()
        else:
            rows, order = branches.inline_profile(kept), [F.desc("instructions"), F.asc("first_address")]
    elif query.kind == "images":
        rows, order = images(snapshot or {}, store.spark), [F.asc("path")]
    elif query.kind == "source":
        rows, order = source(query, store, name), [F.lit(1)]
    elif query.kind == "summary":
        counts = {f"{t}_count": store.read(name, t) for t in ("events", "spans", "gaps")}
        rows, order = records.summary(store.read(name, "threads").withColumnRenamed("id", "thread"), counts), [F.lit(1)]
    else:
        # The manifest's object as it stands, not a list.
        return fit({"schema_version": SCHEMA_VERSION, "analysis": name, "kind": query.kind, "data": manifest.get("quality"), "next_cursor": None, "truncated": False}, offset=offset)
    data, following = take(rows, order, offset, limit)
    if query.kind == "summary":
        data[0]["analyses"] = [{k: m.get(k) for k in ("id", "detail", "decode_mode", "ir_version")} for m in store.catalog()]
    if query.kind == "timeline":
        call_site_names(data, store, name)
    if query.kind == "at_instant":
        call_site_names(data, store, name, "span")
    page = {"schema_version": SCHEMA_VERSION, "analysis": name, "kind": query.kind, "selection": {"thread": s.thread, "start_ns": s.start_ns, "end_ns": s.end_ns}, "quality": manifest.get("quality"), "data": data, "next_cursor": following, "truncated": following is not None}
    if query.kind == "hotpaths":
        page |= {"group": query.group, "sort": query.sort, "totals": totals}
    if not data and whole is not None and query.kind != "at_instant":
        page["hints"] = hints(query, whole)
    return fit(page, offset=offset)
