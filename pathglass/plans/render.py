"""Pages as text: key=value lines, CSV, and a table of hot paths."""

from __future__ import annotations

import io
import json

#: Columns that stand last and are quoted in CSV whatever they hold.
LAST = ("function", "path")


# The columns of each kind's CSV, in the order of the format.
CSV_COLUMNS = {
    "summary": ("covered_start_ns", "covered_end_ns", "duration_estimate_ns", "max_thread_covered_ns", "thread_count", "function_count", "span_count", "event_count", "sample_count", "decode_wall_ms", "trigger_hit_ns", "detail", "quality", "threads", "analyses"),
    "timeline": ("start_ns", "end_ns", "thread_id", "span_id", "parent", "completeness", "clipped", "evidence", "call_site", "call_site_inline", "function"),
    "hotpaths": ("self_sum_ns", "inclusive_sum_ns", "complete_calls", "observed_entries", "instructions", "p50_ns", "p95_ns", "p99_ns", "excluded_incomplete", "n_eligible", "path"),
    "instructions": ("sequence", "time", "len", "kind", "outcome", "branch_target", "fallthrough", "bytes_hex", "id", "thread", "location", "virt_ip", "image_offset", "inlined", "symbol"),
    "branches": ("taken", "not_taken", "unknown", "taken_fraction", "indirect_targets", "site", "symbol"),
    "images": ("archived", "missing", "content_hash", "build_id", "path"),
    "inline_profile": ("instructions", "fraction", "distinct_addresses", "first_address", "symbol", "inlined"),
    "at_instant": ("elapsed_in_innermost_ns", "innermost_start_ns", "innermost_end_ns", "innermost_completeness", "innermost_span_id", "innermost_call_site_inline", "stack", "thread_id"),
    "comparison": ("absolute_delta", "relative_delta", "unit", "normalization", "match_kind", "baseline", "candidate", "baseline_evidence", "candidate_evidence", "path"),
    "source": ("image_offset", "virt_ip", "location_id", "function_id", "file", "line", "inlined", "note", "image_id", "image_path", "function"),
    "quality": ("timing", "gap_count", "incomplete_span_count", "missing_image_count", "decoder_error_count", "ring_truncation", "undecodable_prefix", "gaps_by_kind", "notes"),
}
#: What the rows of pages call some of these columns.
CSV_SOURCES = {
    "summary": {"duration_estimate_ns": "duration_ns", "span_count": "spans_count", "event_count": "events_count", "threads": "top_threads"},
    "timeline": {"thread_id": "thread", "span_id": "id"},
    "hotpaths": {"p50_ns": "p50", "p95_ns": "p95", "p99_ns": "p99"},
    "instructions": {"time": "time_ns"},
    "at_instant": {"elapsed_in_innermost_ns": "elapsed_ns", "innermost_start_ns": "start_ns", "innermost_end_ns": "end_ns", "innermost_span_id": "span", "innermost_call_site_inline": "call_site_inline", "thread_id": "thread"},
    "source": {"location_id": "id", "function_id": "function", "image_path": "path", "function": "symbol"},
}


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return ";".join(_text(v) for v in value)
    if isinstance(value, dict):
        return json.dumps(value, sort_keys=True)
    return str(value)


def _columns(rows: list[dict]) -> list[str]:
    """Numbers first, then text, names last; each in the order of the rows."""
    seen = list(dict.fromkeys(k for r in rows for k in r))
    numeric = [k for k in seen if k not in LAST and all(isinstance(r.get(k), (int, float, type(None))) and not isinstance(r.get(k), bool) for r in rows)]
    return numeric + [k for k in seen if k not in numeric and k not in LAST] + [k for k in LAST if k in seen]


def as_lines(page: dict) -> str:
    rows = page["data"]
    order = _columns(rows)
    lines = [" ".join(f"{k}={_text(r[k])}" for k in order if r.get(k) is not None) for r in rows]
    if page.get("next_cursor"):
        lines.append(f"next_cursor={page['next_cursor']}")
    return "\n".join(lines)


def as_csv(page: dict) -> str:
    """A header and a line for each row, the columns fixed for each kind and otherwise as in the rows.

    The cursor's column stands before the names, which are quoted whatever they hold.
    """
    rows = page["data"] if isinstance(page["data"], list) else [page["data"]] if page["data"] else []
    kind = page.get("kind")
    order = list(CSV_COLUMNS.get(kind) or _columns(rows))
    named = [k for k, c in enumerate(order) if c in LAST]
    order.insert(named[0] if named else len(order), "next_cursor")
    sources = CSV_SOURCES.get(kind, {})
    out = io.StringIO()
    out.write(",".join(order) + "\n")
    for r in rows:
        cells = []
        for c in order:
            text = _text(page.get("next_cursor") if c == "next_cursor" else r.get(sources.get(c, c)))
            quoted = c in LAST or any(x in text for x in ',"\n\r')
            cells.append('"' + text.replace('"', '""') + '"' if quoted else text)
        out.write(",".join(cells) + "\n")
    return out.getvalue()


def short_name(path: str, width: int = 60) -> str:
    """The last name of a path, its head cut if it is too long."""
    name = path.rsplit("/", 1)[-1]
    return name if len(name) <= width else "..." + name[-(width - 3) :]


def as_table(page: dict) -> str:
    """Hot paths: own time, its share of all own time, inclusive time and calls, or instructions and blocks."""
    rows, totals = page["data"], page.get("totals") or {}
    ms = lambda ns: "-" if ns is None else f"{ns / 1e6:.3f}"
    if rows and rows[0].get("instructions") is not None:
        head = ("instructions", "blocks", "name")
        cells = [(str(r["instructions"]), str(r["observed_entries"]), short_name(r["path"])) for r in rows]
    else:
        whole = totals.get("self_sum_ns")
        share = lambda ns: "-" if ns is None or not whole else f"{100 * ns / whole:.1f}"
        head = ("self_ms", "self%", "incl_ms", "calls", "name")
        cells = [(ms(r["self_sum_ns"]), share(r["self_sum_ns"]), ms(r["inclusive_sum_ns"]), str(r["complete_calls"]), short_name(r["path"])) for r in rows]
    widths = [max(len(row[k]) for row in (head, *cells)) for k in range(len(head) - 1)]
    return "\n".join(" ".join([*(c.rjust(w) for c, w in zip(row, widths, strict=False)), row[-1]]) for row in (head, *cells))


def coverage_line(threads: list[dict], ring_bytes: int | None = None, shown: int = 3) -> str:
    """How much time the longest thread covers, and whose coverage that is."""
    if not threads:
        return "coverage: no threads"
    by = sorted(threads, key=lambda t: (-(t.get("covered_ns") or 0), t["thread"]))
    parts = [f"{t['thread']} {(t.get('covered_ns') or 0) / 1e6:.3f} ms" for t in by[:shown]]
    ring = f", ring {ring_bytes} bytes" if ring_bytes else ""
    wrapped = any((t.get("segment_count") or 0) > 1 for t in threads)
    return f"coverage: {(by[0].get('covered_ns') or 0) / 1e6:.3f} ms{ring} ({'; '.join(parts)})" + (" - history was overwritten" if wrapped else "")
