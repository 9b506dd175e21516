"""Call reconstruction in DuckDB's SQL: a recursive query that feeds every thread one record a step.

Written from the transition table, not from the DataFrame code: no record is left
out, no thread is cut, and frames are structs in a list.
"""

from __future__ import annotations

FRAME = "STRUCT(key BIGINT, fn BIGINT, parent BIGINT, t BIGINT, ev BIGINT, started BOOLEAN, site BIGINT)"
OUT = "STRUCT(\"row\" VARCHAR, key BIGINT, \"function\" BIGINT, parent_key BIGINT, start_ns BIGINT, end_ns BIGINT, completeness VARCHAR, start_event BIGINT, end_event BIGINT, call_site BIGINT, kind VARCHAR, extent_known BOOLEAN, reason VARCHAR, mismatch BOOLEAN)"
FRAMES, OUTS = f"CAST([] AS {FRAME}[])", f"CAST([] AS {OUT}[])"


def _frame(fn: str, t: str, started: str = "true", site: str = "NULL", parent: str = "NULL", sub: int = 0) -> str:
    return f"CAST({{'key': 2 * ev + {sub}, 'fn': {fn}, 'parent': {parent}, 't': {t}, 'ev': ev, 'started': {started}, 'site': {site}}} AS {FRAME})"


def _span(f: str, end: str, end_event: str, completeness: str, mismatch: str = "false") -> str:
    return f"CAST({{'row': 'span', 'key': {f}.key, 'function': {f}.fn, 'parent_key': {f}.parent, 'start_ns': {f}.t, 'end_ns': {end}, 'completeness': {completeness}, 'start_event': {f}.ev, 'end_event': {end_event}, 'call_site': {f}.site, 'kind': NULL, 'extent_known': NULL, 'reason': NULL, 'mismatch': {mismatch}}} AS {OUT})"


def _gap(kind: str, start: str, end: str, known: str, reason: str) -> str:
    return f"CAST({{'row': 'gap', 'key': NULL, 'function': NULL, 'parent_key': NULL, 'start_ns': {start}, 'end_ns': {end}, 'completeness': NULL, 'start_event': ev, 'end_event': NULL, 'call_site': NULL, 'kind': '{kind}', 'extent_known': {known}, 'reason': {reason}, 'mismatch': NULL}} AS {OUT})"


def _interrupted(stack: str) -> str:
    span = _span("f", "NULL", "f.ev", "'interrupted_by_gap'")
    return f"list_transform({stack}, lambda f: {span})"


def stacks_sql(records: str, first_of_cpu: bool = True, closed: bool = True, kinds: bool = False) -> str:
    """CTEs ending in ``machine`` (thread, then OUT's fields), over the CTE ``rec`` of ``records``.

    ``first_of_cpu``: a cpu's first time is known; ``closed``: frames close at the end.
    With ``kinds`` rec has a column ``what`` too: s for samples, e and m for errors without
    and with a missing image, x for exits.
    """
    samples, kind, thread = "rec", "'s'", "'t_' || tid"
    if kinds:
        # An exit counts if its thread was seen since the last one; a generation is a task of its own.
        records += """,
marked AS (SELECT *, last_value(CASE WHEN what IN ('s', 'x') THEN what END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rec),
tasks AS (SELECT * REPLACE (tid * 1000 + count(*) FILTER (what = 'x' AND before = 's') OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tid) FROM marked WHERE what <> 'x' OR before = 's')"""
        samples, kind, thread = "tasks WHERE what = 's'", "what", "'t_' || tid // 1000 || CASE WHEN tid % 1000 > 0 THEN '_g' || tid % 1000 ELSE '' END"
    first = "min_by(time_ns, seq) OVER (PARTITION BY cpu)" if first_of_cpu else "CAST(0 AS BIGINT)"
    event = "row_number() OVER (ORDER BY seq) - 1" if first_of_cpu else "seq"
    top, rest = "st[-1]", "list_slice(st, 1, len(st) - 1)"
    final = _span("f", "NULL", "f.ev", "CASE WHEN f.started THEN 'open_both' ELSE 'open_end' END")
    ends = f"UNION ALL SELECT tid, unnest(list_transform(stack, lambda f: {final})) AS o FROM (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n DESC) = 1)" if closed else ""
    leaving = _span("f", "now", "f.ev", "CASE WHEN f.started THEN 'open_both' ELSE 'open_end' END")
    more = """ UNION ALL SELECT tid, seq, NULL, time_ns, NULL, CAST(cpu AS BIGINT), NULL, NULL, NULL, NULL, NULL, what FROM tasks WHERE what <> 's'""" if kinds else ""
    moved = "'thread moved from cpu ' || coalesce(CAST(p.cpu AS VARCHAR), '?') || ' to cpu ' || cpu || '; execution in between was overwritten in the AUX ring'"
    return f"""WITH RECURSIVE {records},
one AS (SELECT tid, seq, {event} AS ev, time_ns AS now, lag(time_ns) OVER (PARTITION BY tid ORDER BY seq) AS last, CAST(cpu AS BIGINT) AS cpu, {first} AS cpu_first,
  ip, nullif((ip >> 8) - 15, 7) AS src, nullif((addr >> 8) - 15, 7) AS dst, flags, {kind} AS rt FROM {samples}{more}),
ev AS MATERIALIZED (SELECT * EXCLUDE seq, row_number() OVER (PARTITION BY tid ORDER BY seq) AS n FROM one),
run AS (
SELECT DISTINCT tid, CAST(0 AS BIGINT) AS n, {FRAMES} AS stack, CAST(NULL AS STRUCT(fn BIGINT, t BIGINT, cpu BIGINT, reason VARCHAR)) AS pending, {OUTS} AS outs FROM ev
UNION ALL
SELECT tid, n,
  CASE WHEN what IN ('cut', 'e', 'm', 'x') THEN {FRAMES} ELSE CASE what
    WHEN 'begin' THEN CASE WHEN len(st) = 0 AND coalesce(dst, src) IS NOT NULL THEN [{_frame("coalesce(dst, src)", "now")}] ELSE st END
    WHEN 'call' THEN list_append(st, {_frame("dst", "now", "false", "ip", f"{top}.key")})
    WHEN 'return' THEN CASE WHEN len(st) > 0 THEN {rest} WHEN dst IS NOT NULL THEN [{_frame("dst", "now", sub=1)}] ELSE st END
    WHEN 'tail' THEN list_append({rest}, {_frame("dst", "now", parent=f"{top}.parent")})
    WHEN 'name' THEN list_append({rest}, CAST({{'key': {top}.key, 'fn': dst, 'parent': {top}.parent, 't': {top}.t, 'ev': {top}.ev, 'started': {top}.started, 'site': {top}.site}} AS {FRAME}))
    ELSE st END END AS stack,
  CASE WHEN what = 'end' THEN {{'fn': src, 't': now, 'cpu': cpu, 'reason': CASE WHEN flags LIKE '%syscall' THEN 'syscall' ELSE 'trace end' END}} WHEN what IN ('e', 'm') THEN held END AS pending,
  list_concat(o, CASE what
    WHEN 'cut' THEN list_append({_interrupted("st")}, {_gap("unknown", "now", "NULL", "false", "'async or interrupt transfer'")})
    WHEN 'e' THEN list_append({_interrupted("st")}, {_gap("decoder_error", "now", "NULL", "false", "'bad'")})
    WHEN 'm' THEN list_append({_interrupted("st")}, {_gap("missing_image", "now", "NULL", "false", "'bad'")})
    WHEN 'x' THEN list_transform(st, lambda f: {leaving})
    WHEN 'return' THEN CASE WHEN len(st) > 0 THEN [{_span(top, "now", "ev", f"CASE WHEN {top}.started THEN 'open_both' ELSE 'complete' END", "coalesce(st[-2].fn <> dst, false)")}]
      ELSE [{_span(_frame("src", "NULL"), "now", "ev", "'uncertain_unwind'")}] END
    WHEN 'tail' THEN CASE WHEN len(st) > 0 THEN [{_span(top, "now", "ev", "'uncertain_unwind'")}] ELSE {OUTS} END
    ELSE {OUTS} END) AS outs
FROM (
SELECT *, CASE WHEN rt <> 's' THEN rt WHEN how IN ('same', 'elsewhere') OR (how = 'moved' AND flags = 'tr strt') THEN 'stop' WHEN starts_with(flags, 'tr end') THEN 'end' WHEN flags IN ('async', 'hw int') THEN 'cut' WHEN flags = 'tr strt' THEN 'begin' WHEN flags = 'syscall' THEN 'stop' WHEN flags = 'call' THEN 'call'
  WHEN flags = 'return' THEN 'return' WHEN src <> dst THEN 'tail' WHEN src IS NULL AND dst IS NOT NULL AND len(st) > 0 AND {top}.fn IS NULL THEN 'name' ELSE 'stop' END AS what FROM (
SELECT tid, n, ev, now, cpu, ip, src, dst, flags, how, rt, p AS held,
  CASE WHEN how = 'none' THEN st0 WHEN how = 'same' THEN CASE WHEN len(st0) = 0 THEN [{_frame("dst", "p.t")}] ELSE st0 END
    WHEN how IN ('moved', 'elsewhere') AND flags = 'tr strt' AND coalesce(dst, src) IS NOT NULL THEN [{_frame("coalesce(dst, src)", "now")}] ELSE {FRAMES} END AS st,
  list_concat(o0, CASE how WHEN 'none' THEN {OUTS} WHEN 'same' THEN [{_gap("trace_boundary", "p.t", "now", "true", "p.reason")}]
    WHEN 'moved' THEN list_append({_interrupted("st0")}, {_gap("ring_truncation", "p.t", "cpu_first", "true", moved)})
    WHEN 'lost' THEN list_append({_interrupted("st0")}, {_gap("unknown", "p.t", "now", "false", "p.reason || '; no trace start before next sample'")})
    ELSE list_append({_interrupted("st0")}, {_gap("unknown", "p.t", "now", "false", "p.reason || '; resumed elsewhere'")}) END) AS o FROM (
SELECT e.*, r.pending AS p, CASE WHEN now < last THEN {FRAMES} ELSE r.stack END AS st0,
  CASE WHEN now < last THEN list_append({_interrupted("r.stack")}, {_gap("time_regression", "last", "now", "true", "'time regression'")}) ELSE {OUTS} END AS o0,
  CASE WHEN r.pending IS NULL OR rt <> 's' THEN 'none' WHEN e.cpu <> r.pending.cpu AND cpu_first > r.pending.t THEN 'moved' WHEN flags <> 'tr strt' THEN 'lost' WHEN dst = r.pending.fn THEN 'same' ELSE 'elsewhere' END AS how
FROM run r JOIN ev e ON e.tid = r.tid AND e.n = r.n + 1)))),
flat AS (SELECT tid, unnest(outs) AS o FROM run {ends}),
machine AS (SELECT {thread} AS thread, o.* FROM flat)
"""
