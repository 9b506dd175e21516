"""The registered queries in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from pathglass.plans.oracle_stacks import stacks_sql
from pathglass.plans.star_queries import DEEP_INSTANT, INSTANT, PAGE, WINDOW
from pathglass.sources.star import LINE, ORIGIN_NS

SPANS = f"""
fn AS (SELECT DISTINCT CAST(o_orderpriority[1] AS BIGINT) AS id, 'order::' || o_orderpriority AS name FROM orders WHERE o_orderpriority[1] <> '4'
  UNION ALL SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS BIGINT) + 100, 'part::' || p_brand FROM part),
roots AS (SELECT o_orderkey * 100 AS id, 't_' || o_custkey AS thread, CASE WHEN o_orderpriority[1] <> '4' THEN CAST(o_orderpriority[1] AS BIGINT) END AS function,
  CAST(NULL AS BIGINT) AS parent, epoch_us(o_orderdate) * 1000 - {ORIGIN_NS} AS start_ns,
  CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) * 1000 - {ORIGIN_NS} + CAST(round(o_totalprice * 100) AS BIGINT) END AS end_ns,
  CASE WHEN o_orderstatus = 'O' THEN 'open_end' ELSE 'complete' END AS completeness FROM orders),
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem),
leaves AS (SELECT l_orderkey * 100 + rn AS id, r.thread, CAST(split_part(p_brand, '#', 2) AS BIGINT) + 100 AS function, r.id AS parent,
  r.start_ns + rn * 1000000 AS start_ns,
  CASE WHEN NOT (l_returnflag = 'R' AND o_orderstatus = 'F') THEN r.start_ns + rn * 1000000 + CAST(round(l_extendedprice * 100) AS BIGINT) END AS end_ns,
  CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'interrupted_by_gap' ELSE 'complete' END AS completeness
  FROM lines JOIN roots r ON r.id = l_orderkey * 100 JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey),
spans AS (SELECT * FROM roots UNION ALL SELECT * FROM leaves),
"""

SELF = """
kids AS (SELECT p.id, greatest(c.start_ns, p.start_ns) AS s, least(c.end_ns, p.end_ns) AS e, c.completeness = 'complete' AND c.start_ns IS NOT NULL AND c.end_ns IS NOT NULL AS sure
  FROM spans p JOIN spans c ON c.parent = p.id WHERE p.completeness = 'complete'),
swept AS (SELECT id, greatest(0, e - greatest(s, coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS fresh FROM kids WHERE e > s),
own AS (SELECT p.id, CASE WHEN coalesce(k.certain, true) THEN p.end_ns - p.start_ns - coalesce(w.covered, 0) END AS self_ns FROM spans p
  LEFT JOIN (SELECT id, bool_and(sure) AS certain FROM kids GROUP BY id) k USING (id)
  LEFT JOIN (SELECT id, sum(fresh) AS covered FROM swept GROUP BY id) w USING (id)
  WHERE p.completeness = 'complete' AND p.start_ns IS NOT NULL AND p.end_ns IS NOT NULL),
"""


def _paths(path: str, where: str = "true", called: str = "completeness = 'complete'", spans: str = "spans") -> str:
    return f"""
named AS (SELECT s.*, coalesce(f.name, '<unknown>') AS name, coalesce(pf.name, '<unknown>') AS outer_name FROM {spans} s
  LEFT JOIN fn f ON f.id = s.function LEFT JOIN {spans} p ON p.id = s.parent LEFT JOIN fn pf ON pf.id = p.function),
shown AS (SELECT *, {path} AS path FROM named),
called AS (SELECT path, {called} AS called, greatest(0, end_ns - start_ns) AS inclusive, self_ns FROM shown LEFT JOIN own USING (id) WHERE {where}),
hot AS (SELECT path, count(*) AS observed_entries, count(*) FILTER (called) AS complete_calls, CAST(sum(inclusive) FILTER (called) AS BIGINT) AS inclusive_sum_ns,
  CAST(sum(self_ns) FILTER (called) AS BIGINT) AS self_sum_ns, count(*) FILTER (NOT called) AS excluded_incomplete, count(inclusive) FILTER (called) AS n_eligible,
  quantile_disc(inclusive, 0.5) FILTER (called) AS p50, quantile_disc(inclusive, 0.95) FILTER (called) AS p95,
  CASE WHEN count(inclusive) FILTER (called) >= 1000 THEN quantile_disc(inclusive, 0.99) FILTER (called) END AS p99 FROM called GROUP BY path)
"""


BY_FUNCTION = _paths("name")
BY_PATH = _paths("CASE WHEN parent IS NULL THEN name ELSE outer_name || '/' || name END")
BY_PATH1 = _paths("CASE WHEN parent IS NULL THEN name ELSE outer_name || '/...' END")
IN_WINDOW = _paths("name", "path LIKE 'part::%'", f"completeness = 'complete' AND coalesce(start_ns >= {WINDOW[0]} AND end_ns <= {WINDOW[1]}, false)")


def _timeline(where: str) -> str:
    low, high = WINDOW
    return f"""WITH {SPANS} t AS (SELECT s.id, thread, f.name AS function, start_ns, end_ns, CASE WHEN completeness = 'complete' THEN greatest(0, end_ns - start_ns) END AS duration_ns,
  completeness, coalesce(start_ns < {low}, false) OR coalesce(end_ns > {high}, false) AS clipped FROM spans s LEFT JOIN fn f ON f.id = s.function
  WHERE coalesce(start_ns, 0) < {high} AND coalesce(end_ns, 9223372036854775807) > {low} AND {where}) SELECT * FROM t"""


RECORDS = """
rec AS (SELECT event_id AS seq, CAST(user_id AS INTEGER) AS tid, CAST(event_id % 8 AS INTEGER) AS cpu, epoch_us(ts) * 1000 AS time_ns,
  4096 + (event_id % 7) * 256 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 AS ip, 4096 + (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) * 256 AS addr,
  CASE event_type WHEN 'view' THEN 'call' WHEN 'purchase' THEN 'return' WHEN 'click' THEN 'jcc' WHEN 'error' THEN 'async' ELSE CASE WHEN event_id % 2 = 0 THEN 'tr end call' ELSE 'tr strt' END END AS flags FROM events),
points AS (SELECT 't_' || tid AS thread, tid, seq, time_ns, starts_with(flags, 'tr strt') AS hole FROM rec),
cut AS (SELECT *, sum(CAST(hole AS INTEGER)) OVER (PARTITION BY thread ORDER BY seq) AS segment FROM points),
segments AS (SELECT thread, min(time_ns) AS start_ns, max(time_ns) AS end_ns FROM cut GROUP BY thread, segment),
lifetimes AS (SELECT c.thread, c.tid, c.branch_count, s.start_ns, s.end_ns, s.covered_ns, s.segment_count, s.segments FROM
  (SELECT thread, min(tid) AS tid, count(*) AS branch_count FROM points GROUP BY thread) c JOIN
  (SELECT thread, min(start_ns) AS start_ns, max(end_ns) AS end_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS covered_ns, count(*) AS segment_count,
    string_agg(start_ns || '-' || end_ns, ' ' ORDER BY start_ns, end_ns) FILTER (k <= 32) AS segments
    FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY start_ns, end_ns) AS k FROM segments) GROUP BY thread) s USING (thread))
"""

INSTRUCTIONS = """
raw AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'click' THEN 'conditional' WHEN 'view' THEN 'sequential' WHEN 'purchase' THEN 'indirect_call' WHEN 'signup' THEN 'return' ELSE 'other' END AS kind FROM events),
ins AS (SELECT event_id AS id, epoch_us(ts) * 1000 AS time_ns, 4194304 + k * 16 AS virt_ip, 'f' || (k % 5) AS symbol, CASE WHEN k % 3 <> 0 THEN 'g' || (k % 3) END AS inlined, kind, user_id, sequence,
  CASE WHEN kind IN ('conditional', 'indirect_call') THEN 5242880 + (event_id % 11) * 16 END AS branch_target,
  CASE WHEN kind = 'conditional' THEN CASE WHEN value >= 30 THEN 'taken' WHEN value >= 5 THEN 'not_taken' ELSE 'unknown' END END AS outcome FROM raw)
"""

RANGES = """
rng AS (SELECT p_partkey AS id, p_name AS name, p_brand, p_size, 4194304 + p_partkey * 64 AS lo, 4194304 + p_partkey * 64 + p_size AS hi, 4194304 + p_partkey * 32 AS ilo, 4194304 + p_partkey * 32 + p_size * 4 AS ihi FROM part),
probe AS (SELECT event_id AS id, 4194304 + (event_id * 37) % 100000 AS address FROM events)
"""


def _profile(where: str) -> str:
    return f"""WITH {INSTRUCTIONS}, s AS (SELECT * FROM ins WHERE {where})
SELECT symbol, inlined, count(*) AS instructions, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM s) AS fraction, count(DISTINCT virt_ip) AS distinct_addresses, '0x' || lower(to_hex(min(virt_ip))) AS first_address FROM s GROUP BY symbol, inlined"""


def _deep(where: str) -> str:
    """CTE r: each event with the names of up to 66 of its user's latest events, and how many there are."""
    return f"""WITH RECURSIVE e AS (SELECT event_id AS id, 't_' || user_id AS thread, epoch_us(ts) * 1000 AS start_ns, CASE WHEN event_id % 13 <> 0 THEN 'step' || (event_id % 5) ELSE '<unknown>' END AS name,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (SELECT *, [name] AS names FROM e WHERE n = 1 UNION ALL SELECT e.*, list_append(w.names[-65:], e.name) FROM walk w JOIN e ON e.thread = w.thread AND e.n = w.n + 1),
r AS (SELECT * FROM walk WHERE {where})
"""


def _sites(where: str) -> str:
    """An indirect branch goes to the instruction that its thread ran next, if that is known."""
    return f"""WITH {INSTRUCTIONS}, kept AS (SELECT * FROM ins WHERE {where}),
f AS (SELECT a.*, b.virt_ip AS target FROM kept a LEFT JOIN kept b ON b.user_id = a.user_id AND b.sequence = a.sequence + 1),
s AS (SELECT * FROM f WHERE kind = 'conditional' OR (kind = 'indirect_call' AND target IS NOT NULL)),
t AS (SELECT virt_ip, string_agg('0x' || lower(to_hex(target)), ' ' ORDER BY first) AS targets FROM (SELECT virt_ip, target, min(id) AS first FROM s WHERE kind = 'indirect_call' GROUP BY ALL) GROUP BY virt_ip),
g AS (SELECT virt_ip, arg_min(symbol, id) AS symbol, count(*) FILTER (outcome = 'taken') AS taken, count(*) FILTER (outcome = 'not_taken') AS not_taken, count(*) FILTER (outcome = 'unknown') AS unknown FROM s GROUP BY virt_ip),
sites AS (SELECT '0x' || lower(to_hex(virt_ip)) AS site, symbol, taken, not_taken, unknown, CASE WHEN taken + not_taken > 0 THEN printf('%.6f', CAST(taken AS DOUBLE) / (taken + not_taken)) END AS taken_fraction, coalesce(targets, '') AS indirect_targets FROM g LEFT JOIN t USING (virt_ip))
"""


def _year_rows(name: str, low: int, high: int) -> str:
    """Hot paths of the spans of some years, as (path, inclusive_sum_ns, complete_calls, excluded_incomplete)."""
    return f"""
{name}_spans AS (SELECT * FROM spans WHERE year(make_timestamp((start_ns + {ORIGIN_NS}) // 1000)) BETWEEN {low} AND {high}),
{name} AS (SELECT coalesce(f.name, '<unknown>') AS path, CAST(sum(end_ns - start_ns) FILTER (completeness = 'complete') AS BIGINT) AS inclusive_sum_ns,
  count(*) FILTER (completeness = 'complete') AS complete_calls, count(*) FILTER (completeness <> 'complete') AS excluded_incomplete
  FROM {name}_spans s LEFT JOIN fn f ON f.id = s.function GROUP BY 1)"""


def _compare(b_path: str, c_path: str, pairs: str) -> str:
    stem = "regexp_replace(split_part(path, '/', -1), '::h[0-9a-fA-F]{8,}$', '')"
    number = "row_number() OVER (ORDER BY inclusive_sum_ns DESC NULLS LAST, path) AS i"
    return f"""WITH {SPANS} {_year_rows("b0", 1990, 1996)}, {_year_rows("c0", 1997, 2010)},
b1 AS (SELECT * REPLACE ({b_path} AS path) FROM b0), c1 AS (SELECT * REPLACE ({c_path} AS path) FROM c0),
b AS (SELECT *, {number}, {stem} AS stem, count(*) OVER (PARTITION BY {stem}) AS n FROM b1), c AS (SELECT *, {number}, {stem} AS stem, count(*) OVER (PARTITION BY {stem}) AS n FROM c1),
pairs AS (SELECT * FROM (VALUES {pairs}) AS t(k, x, y)),
hits AS (SELECT k, (SELECT min(i) FROM b WHERE ends_with(b.path, x)) AS bi, (SELECT min(i) FROM c WHERE ends_with(c.path, y)) AS ci FROM pairs),
explicit AS (SELECT 0 AS phase, k AS pl, bi, ci, CASE WHEN bi IS NULL OR ci IS NULL THEN 'unmatched' ELSE 'explicit_pair' END AS kind FROM hits WHERE bi IS NOT NULL OR ci IS NOT NULL),
fb AS (SELECT * FROM b WHERE i NOT IN (SELECT bi FROM explicit WHERE bi IS NOT NULL)), fc AS (SELECT * FROM c WHERE i NOT IN (SELECT ci FROM explicit WHERE ci IS NOT NULL)),
base AS (SELECT fb.i AS bi, fb.path AS bp, fb.n > 1 OR coalesce((SELECT count(*) FROM c WHERE c.stem = fb.stem), 0) > 1 AS vague, fc.i AS ci, fc.path AS cp FROM fb LEFT JOIN fc ON fc.stem = fb.stem
  QUALIFY row_number() OVER (PARTITION BY fb.i ORDER BY fc.i) = 1),
second AS (SELECT 1 AS phase, bi AS pl, bi, CASE WHEN vague THEN NULL ELSE ci END AS ci, CASE WHEN vague THEN 'ambiguous' WHEN ci IS NULL THEN 'unmatched' WHEN bp = cp THEN 'path' ELSE 'demangled_path' END AS kind FROM base),
third AS (SELECT 2 AS phase, i AS pl, NULL AS bi, i AS ci, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS kind FROM fc WHERE i NOT IN (SELECT ci FROM second WHERE ci IS NOT NULL)),
every AS (SELECT * FROM explicit UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third),
joined AS (SELECT row_number() OVER (ORDER BY phase, pl) AS ord, kind, b.path AS bp, c.path AS cp, b.inclusive_sum_ns AS bv, c.inclusive_sum_ns AS cv, b.i AS bi, c.i AS ci,
  b.complete_calls AS bn, c.complete_calls AS cn, b.excluded_incomplete AS be, c.excluded_incomplete AS ce, kind IN ('explicit_pair', 'path', 'demangled_path') AS matched
  FROM every LEFT JOIN b ON b.i = every.bi LEFT JOIN c ON c.i = every.ci)
SELECT ord, coalesce(bp, cp) AS path, CASE WHEN bi IS NOT NULL THEN coalesce(bv, 0) END AS baseline_value, bn AS baseline_n, be AS baseline_exclusions,
  CASE WHEN ci IS NOT NULL THEN coalesce(cv, 0) END AS candidate_value, cn AS candidate_n, ce AS candidate_exclusions,
  CASE WHEN matched THEN cv - bv END AS absolute_delta, CASE WHEN matched AND bv <> 0 THEN CAST(cv - bv AS DOUBLE) / bv END AS relative_delta,
  'ns_decoder_estimate' AS unit, CASE WHEN matched THEN 'per_matched_path' ELSE 'raw_selected_region' END AS normalization, kind AS match_kind FROM joined"""


def _renamed(salt: str) -> str:
    return f"CASE WHEN regexp_matches(path, 'Brand#1[0-9]$') THEN regexp_replace(path, '#.*$', '') || '::h{salt}' || lpad(regexp_extract(path, '([0-9]+)$', 1), 6, '0') ELSE path || '::h{salt}aaaaaa' END"


_STEP = "time_ns - lag(time_ns) OVER (PARTITION BY tid ORDER BY seq)"

_RECORDS_ONLY = RECORDS[: RECORDS.index("points AS")].rstrip().rstrip(",")
#: Instructions: blocks of 256 bytes from 0x1000 on, mapped to offset 256 up to 0x1600; a segment holds 1024 bytes behind it.
_CODE = f"""WITH {_RECORDS_ONLY}, x AS (SELECT rec.*, event_type = 'error' AS bad, CASE event_type WHEN 'click' THEN '740e' WHEN 'view' THEN '90' WHEN 'purchase' THEN 'ffd0' WHEN 'signup' THEN 'c3' END AS hex, min(seq) FILTER (event_type <> 'error') OVER (PARTITION BY tid) AS begun FROM rec JOIN events ON event_id = seq),
y AS (SELECT *, len(hex) // 2 AS len, CASE hex WHEN '740e' THEN 'conditional' WHEN '90' THEN 'sequential' WHEN 'ffd0' THEN 'indirect_call' WHEN 'c3' THEN 'return' END AS kind, CASE WHEN hex = '740e' THEN ip + 16 END AS branch_target,
  sum(CASE WHEN seq >= begun THEN 1 ELSE 0 END) OVER p AS sequence, lead(ip) OVER p AS next_ip, lead(bad) OVER p AS next_bad, CASE WHEN ip < 5632 THEN '/bin/star' ELSE '/bin/old' END AS path, CASE WHEN ip < 5632 THEN 'i' END AS image_id,
  CASE WHEN ip < 5120 THEN 4194304 + ip - 4096 WHEN ip < 5632 THEN ip - 4096 + 256 END AS image_offset FROM x WINDOW p AS (PARTITION BY tid ORDER BY seq)),
located AS (SELECT *, CASE WHEN image_offset >= 4194304 AND image_offset % 256 < 12 THEN 'f' || (image_offset % 4194304) // 256 END AS symbol, CASE WHEN image_offset >= 4194304 AND image_offset % 256 BETWEEN 4 AND 7 THEN 'g' || (image_offset % 4194304) // 256 % 2 END AS inlined,
  CASE WHEN image_offset >= 4194304 AND image_offset % 256 BETWEEN 4 AND 7 THEN CAST((image_offset % 4194304) // 256 AS INTEGER) END AS line FROM y)
"""
#: LINE taken apart by hand: at each of its 16 bytes the length, the kind, and how far behind the address a target lies.
_LINE = """(VALUES (0, 2, 'conditional', 4), (1, 6, 'sequential', NULL), (2, 1, 'sequential', NULL), (3, 3, 'sequential', NULL), (4, 2, 'sequential', NULL), (5, 2, 'sequential', NULL), (6, 5, 'call', 5), (7, 2, 'sequential', NULL),
  (8, 2, 'sequential', NULL), (9, 2, 'sequential', NULL), (10, 2, 'sequential', NULL), (11, 2, 'indirect_call', NULL), (12, 2, 'sequential', NULL), (13, 1, 'return', NULL), (14, 2, 'jump', -110), (15, 1, 'sequential', NULL)) AS l(spot, n, k, far)"""
#: Every third error names no task, every third is an exit; what goes on behind an exit is a new generation.
_FROM_IMAGE = f"""WITH {_RECORDS_ONLY}, x AS (SELECT rec.*, CASE WHEN event_type <> 'error' THEN 's' WHEN seq % 3 = 0 THEN 'n' WHEN seq % 3 = 1 THEN 'x' ELSE 'e' END AS what FROM rec JOIN events ON event_id = seq),
lost AS (SELECT seq, tid, what, ip, time_ns, count(*) FILTER (what = 'n') OVER (ORDER BY seq) AS nowhere FROM x),
own AS (SELECT *, nowhere + count(*) FILTER (what = 'e') OVER p AS errors, count(*) FILTER (what = 'x') OVER p AS exits FROM lost WHERE what <> 'n' WINDOW p AS (PARTITION BY tid ORDER BY seq)),
s AS (SELECT *, row_number() OVER p AS n, CASE WHEN exits > coalesce(lag(exits) OVER p, 0) THEN 1 ELSE 0 END AS fresh, lead(ip) OVER p AS next_ip, lead(errors) OVER p AS next_errors FROM own WHERE what = 's' WINDOW p AS (PARTITION BY tid ORDER BY seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY seq) AS generation FROM s),
h AS (SELECT *, 1 + n - min(n) OVER q + errors - min(errors) OVER q AS sequence FROM g WINDOW q AS (PARTITION BY tid, generation)),
placed AS (SELECT *, ip >= 5632 AS outside, CASE WHEN ip < 5120 THEN 4194304 + ip - 4096 WHEN ip < 5632 THEN ip - 4096 + 256 END AS image_offset FROM h),
y AS (SELECT p.*, spot, l.n AS size, k, far, outside AND seq % 2 = 1 AS blind, substr(repeat('{LINE.replace(" ", "")}', 2), 2 * spot + 1, 30) AS hex FROM placed p JOIN {_LINE} ON spot = ip % 16),
z AS (SELECT *, CASE WHEN blind THEN 'other' ELSE k END AS kind, CASE WHEN blind THEN 0 ELSE size END AS len FROM y)
"""
#: Runs between branches of a thread, as far as one mapping holds them, and the instructions of each: those that begin in it.
_RAN = f"""WITH {_RECORDS_ONLY}, b AS (SELECT seq, tid, ip, time_ns, flags, lag(CASE WHEN flags NOT IN ('tr end call', 'async') THEN addr + seq % 2 * 4 END) OVER p AS start, time_ns - lag(time_ns) OVER p AS dt FROM rec WINDOW p AS (PARTITION BY tid ORDER BY seq)),
ran AS (SELECT tid, start, ip AS stop, dt FROM b WHERE start IS NOT NULL AND flags <> 'tr strt' AND ip >= start AND ip < 5632),
distinct_runs AS (SELECT DISTINCT start, stop FROM ran),
counted AS (SELECT start, stop, CAST(len(list_filter(range(start, stop + 1), lambda a: a = start OR a % 16 IN (0, 2, 3, 6, 11, 13, 14))) AS BIGINT) AS n FROM distinct_runs),
inline_sums AS (SELECT 't_' || tid AS thread, CASE WHEN start < 5120 THEN (start - 4096) // 256 END AS "function", CASE WHEN start < 5120 AND start % 256 >= 4 THEN 'g' || (start - 4096) // 256 % 2 ELSE '' END AS chain,
  CAST(sum(n) AS BIGINT) AS instructions, count(*) AS blocks, CAST(sum(greatest(dt, 0)) AS BIGINT) AS elapsed_ns FROM ran JOIN counted USING (start, stop) GROUP BY ALL)
"""
#: Two streams merged by their latest times so far.
_MERGED = _RECORDS_ONLY.replace("rec AS", "every AS") + """, early AS (SELECT * REPLACE (time_ns - CASE WHEN seq % 31 = 0 THEN 7200000000000 ELSE 0 END AS time_ns) FROM every),
latest AS (SELECT *, max(time_ns) OVER (PARTITION BY cpu % 2 ORDER BY seq) AS latest FROM early),
rec AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (ORDER BY latest, cpu % 2, seq) - 1 AS seq) FROM latest)"""
#: All that can befall a stack, by the number of an event that was asynchronous.
_KINDS = _RECORDS_ONLY.replace("rec AS", "every AS") + """, rec AS MATERIALIZED (SELECT * EXCLUDE flags REPLACE (time_ns - CASE WHEN seq % 31 = 0 THEN 7200000000000 ELSE 0 END AS time_ns),
  CASE WHEN flags = 'async' AND seq % 6 = 1 THEN 'hw int' WHEN flags = 'async' AND seq % 6 = 2 THEN 'syscall' WHEN flags = 'tr end call' AND seq % 4 = 0 THEN 'tr end syscall' ELSE flags END AS flags,
  CASE WHEN flags = 'async' THEN CASE seq % 6 WHEN 3 THEN 'm' WHEN 4 THEN 'e' WHEN 5 THEN 'x' ELSE 's' END ELSE 's' END AS what FROM every)"""
#: Records of four processes.
_PROCESSES = """WITH p AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'decoder_error' WHEN 'signup' THEN 'task' WHEN 'purchase' THEN 'mmap' ELSE 'sample' END AS record_type,
  CASE WHEN NOT (event_type = 'error' AND event_id % 4 = 0) THEN CAST(user_id % 4 + 1 AS INTEGER) END AS pid, CASE WHEN NOT (event_type = 'error' AND event_id % 4 IN (0, 1)) THEN CAST(user_id AS INTEGER) END AS tid FROM events)
"""
_BITS = """flags = 'tr strt' AS trace_begin, flags = 'tr end call' AS trace_end, flags = 'async' AS async_event, false AS "transaction", false AS interrupt, false AS syscall"""

ORACLE_SQL = {
    "reconstruct_spans": stacks_sql(_RECORDS_ONLY) + """SELECT key AS id, thread, "function", parent_key AS parent, start_ns, end_ns, completeness, start_event, end_event, call_site FROM machine WHERE "row" = 'span'""",
    "reconstruct_gaps": stacks_sql(_RECORDS_ONLY) + """SELECT thread, kind, start_ns, end_ns, extent_known, reason FROM machine WHERE "row" = 'gap'""",
    "stream_reconstruct": stacks_sql(_RECORDS_ONLY, first_of_cpu=False, closed=False) + "SELECT * FROM machine",
    "reconstruct_gaps_by_kind": stacks_sql(_RECORDS_ONLY) + """SELECT kind, count(*) AS n FROM machine WHERE "row" = 'gap' GROUP BY kind""",
    "reconstruct_quality": stacks_sql(_RECORDS_ONLY) + f"""SELECT count(*) FILTER ("row" = 'span' AND completeness <> 'complete') AS incomplete_spans, count(*) FILTER (mismatch) AS unwind_mismatches, count(*) FILTER ("row" = 'gap') AS gaps,
  count(*) FILTER (kind = 'decoder_error') AS decoder_errors, count(*) FILTER (kind = 'missing_image') AS missing_images, count(*) FILTER (kind = 'ring_truncation') AS ring_holes,
  CAST(0 AS BIGINT) AS lost_records, (SELECT count(*) FROM rec) AS samples, (SELECT count(*) FROM rec WHERE time_ns IS NULL) AS unknown_times,
  (SELECT min(step) FROM (SELECT {_STEP} AS step FROM rec) WHERE step > 0) AS min_time_step_ns, CAST(0 AS BIGINT) AS foreign_samples, CAST(0 AS BIGINT) AS foreign_pids FROM machine""",
    "instruction_rows": _CODE + """SELECT seq AS id, 't_' || tid AS thread, CAST(sequence AS BIGINT) AS sequence, time_ns, CAST(NULL AS BIGINT) AS location, ip AS virt_ip, symbol, inlined, image_offset, CAST(len AS INTEGER) AS len, kind, branch_target, CASE WHEN kind <> 'return' THEN ip + len END AS fallthrough,
  CASE WHEN kind = 'conditional' THEN CASE WHEN coalesce(next_bad, true) THEN 'unknown' WHEN next_ip = branch_target THEN 'taken' WHEN next_ip = ip + len THEN 'not_taken' ELSE 'unknown' END END AS outcome, rtrim(regexp_replace(hex, '(..)', '\\1 ', 'g')) AS bytes_hex FROM located WHERE NOT bad""",
    "instruction_rows_from_image": _FROM_IMAGE + """SELECT seq AS id, 't_' || tid || CASE WHEN generation > 0 THEN '_g' || generation ELSE '' END AS thread, CAST(sequence AS BIGINT) AS sequence, time_ns, CAST(NULL AS BIGINT) AS location, ip AS virt_ip,
  CASE WHEN ip < 5120 AND ip % 256 < 12 THEN 'f' || (ip - 4096) // 256 END AS symbol, CASE WHEN ip < 5120 AND ip % 256 BETWEEN 4 AND 7 THEN 'g' || (ip - 4096) // 256 % 2 END AS inlined, image_offset, CAST(len AS INTEGER) AS len, kind,
  CASE WHEN NOT blind THEN ip + far END AS branch_target, CASE WHEN NOT blind AND kind <> 'return' THEN ip + len END AS fallthrough,
  CASE WHEN kind = 'conditional' THEN CASE WHEN next_ip IS NULL OR next_errors > errors THEN 'unknown' WHEN next_ip = ip + far THEN 'taken' WHEN next_ip = ip + len THEN 'not_taken' ELSE 'unknown' END END AS outcome,
  CASE WHEN blind THEN '' ELSE rtrim(regexp_replace(hex, '(..)', '\\1 ', 'g')) END AS bytes_hex FROM z""",
    "inline_attribution": _RAN + "SELECT * FROM inline_sums",
    "hotpaths_inline_attributed": _RAN + """SELECT coalesce('f' || "function", '<unknown>') || CASE WHEN chain <> '' THEN ' > ' || chain ELSE '' END AS path, CAST(sum(blocks) AS BIGINT) AS observed_entries, CAST(sum(elapsed_ns) AS BIGINT) AS self_sum_ns, CAST(sum(instructions) AS BIGINT) AS instructions FROM inline_sums GROUP BY path""",
    "every_kind_spans": stacks_sql(_KINDS, kinds=True) + """SELECT key AS id, thread, "function", parent_key AS parent, start_ns, end_ns, completeness, start_event, end_event, call_site FROM machine WHERE "row" = 'span'""",
    "every_kind_gaps": stacks_sql(_KINDS, kinds=True) + """SELECT thread, kind, start_ns, end_ns, extent_known, reason FROM machine WHERE "row" = 'gap'""",
    "live_records": _PROCESSES + "SELECT seq, record_type, pid, tid FROM p WHERE pid IN (1, 3) AND (record_type <> 'decoder_error' OR tid IS NOT NULL) OR (record_type = 'decoder_error' AND pid IS NULL)",
    "foreign_samples": _PROCESSES + "SELECT pid, count(*) AS samples FROM p WHERE record_type = 'sample' AND pid NOT IN (1, 3) GROUP BY pid",
    "merged_streams_spans": stacks_sql(_MERGED) + """SELECT key AS id, thread, "function", parent_key AS parent, start_ns, end_ns, completeness, start_event, end_event, call_site FROM machine WHERE "row" = 'span'""",
    "merged_streams_gaps": stacks_sql(_MERGED) + """SELECT thread, kind, start_ns, end_ns, extent_known, reason FROM machine WHERE "row" = 'gap'""",
    "located_instructions": _CODE + """SELECT path, image_id, symbol, inlined, count(*) AS n, min(image_offset) AS low, max(image_offset) AS high, max(line) AS line FROM located GROUP BY ALL""",
    "retained_events": f"""WITH {_RECORDS_ONLY}, n AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS id, nullif((ip >> 8) - 15, 7) AS src, nullif((addr >> 8) - 15, 7) AS dst FROM rec)
SELECT id, 't_' || tid AS thread, seq AS sequence, time_ns, ip AS from_ip, addr AS to_ip, CASE flags WHEN 'tr strt' THEN 'trace_begin' WHEN 'tr end call' THEN 'trace_end' WHEN 'async' THEN 'async_boundary' WHEN 'call' THEN 'call' WHEN 'return' THEN 'return' ELSE 'conditional' END AS kind, {_BITS}
FROM n WHERE NOT (flags = 'jcc' AND src IS NOT DISTINCT FROM dst)""",
    "hotpaths_function": f"WITH {SPANS} {SELF} {BY_FUNCTION} SELECT * FROM hot",
    "hotpaths_self_time": f"WITH {SPANS} {SELF} {BY_FUNCTION} SELECT row_number() OVER (ORDER BY self_sum_ns DESC NULLS LAST, inclusive_sum_ns DESC NULLS LAST, path) AS ord, path, observed_entries, inclusive_sum_ns, self_sum_ns FROM hot",
    "hotpaths_calls": f"WITH {SPANS} {SELF} {BY_FUNCTION} SELECT row_number() OVER (ORDER BY observed_entries DESC, path) AS ord, path, observed_entries, inclusive_sum_ns, self_sum_ns FROM hot",
    "hotpaths_path": f"WITH {SPANS} {SELF} {BY_PATH} SELECT * FROM hot",
    "hotpaths_path_depth1": f"WITH {SPANS} {SELF} {BY_PATH1} SELECT * FROM hot",
    "hotpaths_window": f"WITH {SPANS} {SELF} {IN_WINDOW} SELECT * FROM hot",
    "hotpaths_inline": f"""WITH {SPANS} x AS (SELECT coalesce(f.name, '<unknown>') || ' > ' || p_brand || ' > ' || p_type AS path, CAST(l_quantity AS BIGINT) AS n, CAST(round(l_extendedprice) AS BIGINT) AS t
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey LEFT JOIN fn f ON f.id = CASE WHEN o_orderpriority[1] <> '4' THEN CAST(o_orderpriority[1] AS BIGINT) END)
SELECT path, count(*) AS observed_entries, CAST(0 AS BIGINT) AS complete_calls, CAST(sum(t) AS BIGINT) AS self_sum_ns, count(*) AS n_eligible, CAST(sum(n) AS BIGINT) AS instructions FROM x GROUP BY path""",
    "hotpaths_totals": f"WITH {SPANS} {SELF} {BY_FUNCTION} SELECT CAST(sum(self_sum_ns) AS BIGINT) AS self_sum_ns, CAST(sum(inclusive_sum_ns) AS BIGINT) AS inclusive_sum_ns, CAST(sum(complete_calls) AS BIGINT) AS complete_calls, CAST(NULL AS BIGINT) AS instructions FROM hot",
    "self_time_per_span": f"WITH {SPANS} {SELF} z AS (SELECT 1) SELECT id, CAST(self_ns AS BIGINT) AS self_ns FROM own",
    "nearest_rank_quantiles": "SELECT l_returnflag, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem) GROUP BY l_returnflag",
    "timeline": f"""WITH {SPANS} z AS (SELECT 1) SELECT s.id, thread, f.name AS function, start_ns, end_ns, CASE WHEN completeness = 'complete' THEN greatest(0, end_ns - start_ns) END AS duration_ns, completeness, false AS clipped
  FROM spans s LEFT JOIN fn f ON f.id = s.function""",
    "timeline_window": _timeline("true"),
    "timeline_filtered": _timeline("end_ns - start_ns >= 5000000 AND contains(f.name, 'Brand#1')"),
    "timeline_page2": _timeline("true") + f" ORDER BY start_ns ASC NULLS FIRST, 'a:sp' || id LIMIT {PAGE} OFFSET {PAGE}",
    "at_instant": f"""WITH {SPANS} named AS (SELECT s.*, coalesce(f.name, '<unknown>') AS name, coalesce(pf.name, '<unknown>') AS outer_name FROM spans s
  LEFT JOIN fn f ON f.id = s.function LEFT JOIN spans p ON p.id = s.parent LEFT JOIN fn pf ON pf.id = p.function),
o AS (SELECT *, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth FROM named WHERE start_ns <= {INSTANT} AND (end_ns IS NULL OR end_ns > {INSTANT}))
SELECT thread, id AS span, name AS function, CAST(depth AS BIGINT) AS depth, start_ns, end_ns, {INSTANT} - start_ns AS elapsed_ns, CASE WHEN depth = 0 THEN name ELSE outer_name || ' > ' || name END AS stack
FROM o QUALIFY row_number() OVER (PARTITION BY thread ORDER BY depth DESC, start_ns DESC, id) = 1""",
    "compare_function": _compare("path", "path", "(0, 'order::1-URGENT', 'order::2-HIGH'), (1, 'Brand#7', 'no such function')"),
    "compare_ambiguous": _compare(_renamed("ab"), _renamed("cd"), "(0, NULL, NULL)"),
    "branches": _sites("id % 7 <> 3") + "SELECT * FROM sites",
    "branches_order": _sites("true") + "SELECT row_number() OVER (ORDER BY taken + not_taken + unknown DESC, site) AS ord, site, taken_fraction FROM sites",
    "inline_profile": _profile("true"),
    "inline_profile_window": _profile("time_ns >= 1704500000000000000 AND time_ns < 1706000000000000000"),
    "deep_paths": _deep("true") + """SELECT id, CAST(least(n - 1, 64) AS BIGINT) AS depth, CASE WHEN n > 64 THEN '.../' || array_to_string(names[-64:], '/') ELSE array_to_string(names, '/') END AS path FROM r""",
    "deep_at_instant": _deep(f"start_ns <= {DEEP_INSTANT}") + f"""SELECT thread, id AS span, names[-1] AS function, CAST(least(n - 1, 65) AS BIGINT) AS depth, start_ns, CAST(NULL AS BIGINT) AS end_ns, {DEEP_INSTANT} - start_ns AS elapsed_ns, array_to_string(names, ' > ') AS stack
  FROM r QUALIFY row_number() OVER (PARTITION BY thread ORDER BY least(n - 1, 65) DESC, start_ns DESC, id) = 1""",
    "instruction_outcome": f"""WITH {RECORDS}, s AS (SELECT seq, tid, flags = 'async' AS bad, ip - ip % 256 AS pl, CASE WHEN flags = 'jcc' THEN 'conditional' ELSE 'other' END AS kind, addr AS target, ip + 512 AS fall FROM rec),
b AS (SELECT *, min(seq) FILTER (NOT bad) OVER (PARTITION BY tid) AS begun FROM s),
w AS (SELECT *, sum(CASE WHEN seq >= begun THEN 1 ELSE 0 END) OVER p AS sequence, lead(pl) OVER p AS next_at, lead(bad) OVER p AS next_bad FROM b WINDOW p AS (PARTITION BY tid ORDER BY seq))
SELECT seq, tid, CAST(sequence AS BIGINT) AS sequence, kind, CASE WHEN kind = 'conditional' THEN CASE WHEN coalesce(next_bad, true) OR target = fall THEN 'unknown' WHEN next_at = target THEN 'taken' WHEN next_at = fall THEN 'not_taken' ELSE 'unknown' END END AS outcome FROM w WHERE NOT bad""",
    "straight_blocks": f"""WITH {RECORDS}, w AS (SELECT 't_' || tid AS thread, lag(addr) OVER p AS s, ip AS e, time_ns - lag(time_ns) OVER p AS dt, lag(flags IN ('async', 'tr end call')) OVER p AS broken FROM rec WINDOW p AS (PARTITION BY tid ORDER BY seq))
SELECT thread, s >> 8 AS function, 'all' AS chain, CAST(sum(1 + e - s) AS BIGINT) AS instructions, count(*) AS blocks, CAST(sum(greatest(0, coalesce(dt, 0))) AS BIGINT) AS elapsed_ns FROM w WHERE NOT broken AND e >= s AND e - s <= 1048576 GROUP BY ALL""",
    "coverage_segments": f"WITH {RECORDS} SELECT * FROM segments",
    "threads_summary": f"WITH {RECORDS} SELECT * EXCLUDE (tid) FROM lifetimes",
    "summary": f"""WITH {SPANS} {RECORDS} SELECT min(start_ns) AS covered_start_ns, max(end_ns) AS covered_end_ns, max(covered_ns) AS max_thread_covered_ns, count(*) AS thread_count,
  (SELECT string_agg(thread, ' ' ORDER BY branch_count DESC, tid) FROM (SELECT * FROM lifetimes ORDER BY branch_count DESC, tid LIMIT 32)) AS top_threads,
  (SELECT count(*) FROM spans) AS span_count, (SELECT count(*) FROM fn) AS function_count, max(end_ns) - min(start_ns) AS duration_ns FROM lifetimes""",
    "gaps_by_kind": f"WITH {RECORDS}, q AS (SELECT {_STEP} AS quiet FROM rec) SELECT CASE WHEN quiet < 60000000000 THEN 'trace_boundary' WHEN quiet < 3600000000000 THEN 'unknown' ELSE 'ring_truncation' END AS kind, count(*) AS n FROM q WHERE quiet IS NOT NULL GROUP BY 1",
    "quality_counters": f"WITH {SPANS} {RECORDS}, q AS (SELECT *, {_STEP} AS step FROM rec) SELECT count(*) AS samples, count(*) FILTER (flags = 'async') AS interruptions, count(*) FILTER (time_ns IS NULL) AS unknown_times, min(step) FILTER (step > 0) AS min_time_step_ns, (SELECT count(*) FROM spans WHERE completeness <> 'complete') AS incomplete_spans FROM q",
    "first_cpu_times": f"WITH {RECORDS} SELECT cpu, arg_min(time_ns, seq) AS first_ns FROM rec GROUP BY cpu",
    "time_regressions": """WITH p AS (SELECT 't_' || user_id AS thread, CAST(round(value * 1000) AS BIGINT) * 1000000 + event_id AS seq, epoch_us(ts) * 1000 AS time_ns FROM events),
w AS (SELECT thread, seq, lag(time_ns) OVER (PARTITION BY thread ORDER BY seq) AS previous_ns, time_ns FROM p) SELECT * FROM w WHERE time_ns < previous_ns""",
    "trigger_location": f"WITH {RECORDS} SELECT count(*) AS traps, max(time_ns) AS last_ns FROM rec WHERE ip = 4352 AND flags = 'async'",
    "tail_window": f"WITH {RECORDS} SELECT seq, tid, time_ns FROM rec WHERE time_ns >= (SELECT max(time_ns) FROM rec) - 86400000000000",
    "symbolize_asof": f"WITH {RANGES} SELECT p.id, address, CASE WHEN address < hi THEN r.id END AS function, CASE WHEN address < hi THEN name END AS symbol, CASE WHEN address < hi THEN address - lo END AS \"offset\" FROM probe p ASOF LEFT JOIN rng r ON p.address >= r.lo",
    "map_range_join": """WITH m AS (SELECT p_partkey % 3 AS pid, 4194304 + p_partkey * 4096 AS lo, 4194304 + p_partkey * 4096 + p_size * 1024 AS hi, p_partkey AS g, p_name FROM part),
s AS (SELECT event_id AS id, event_id % 3 AS pid, 4194304 + (event_id * 7919) % 9000000 AS ip FROM events)
SELECT s.id, CAST(s.pid AS INTEGER) AS pid, s.ip, m.lo AS map_start, m.g AS generation, m.p_name AS path FROM s LEFT JOIN m ON m.pid = s.pid AND s.ip >= m.lo AND s.ip < m.hi AND m.g <= s.id QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY m.g DESC) = 1""",
    "inline_frames": f"""WITH {RANGES} SELECT p.id, address, CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS inlined, p_size AS line FROM probe p LEFT JOIN rng r ON address >= ilo AND address < ihi
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY ihi - ilo, ilo) = 1""",
    "process_tree": """WITH RECURSIVE f AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
t AS (SELECT unnest(['r1', 'r3']) AS pid, CAST(0 AS BIGINT) AS depth UNION ALL SELECT child, depth + 1 FROM t JOIN f ON parent = pid) SELECT pid, min(depth) AS depth FROM t GROUP BY pid""",
    "live_foreign": f"WITH {RECORDS} SELECT flags, count(*) AS n FROM rec WHERE tid % 3 = 0 AND tid < 100 GROUP BY flags UNION ALL SELECT 'foreign', count(*) FROM rec WHERE NOT (tid % 3 = 0 AND tid < 100)",
    "merge_streams": """WITH u AS (SELECT 0 AS stream, o_orderkey AS seq, epoch_us(o_orderdate) AS pl FROM orders UNION ALL SELECT 1, l_orderkey * 10 + l_linenumber, epoch_us(l_shipdate) FROM lineitem WHERE l_linenumber <> 1)
SELECT CAST(stream AS INTEGER) AS stream, CAST(floor(coalesce(pl, 0) / 86400000000) AS BIGINT) AS day, count(*) AS n, min(seq) AS first, max(seq) AS last FROM u GROUP BY 1, 2""",
    "thread_generations": f"""WITH {RECORDS}, x AS (SELECT seq, tid, flags = 'return' AS is_exit, lag(flags) OVER (PARTITION BY tid ORDER BY seq) AS before FROM rec),
c AS (SELECT *, CAST(is_exit AND before IS NOT NULL AND before <> 'return' AS INTEGER) AS counts FROM x),
g AS (SELECT seq, tid, CAST(coalesce(sum(counts) OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS generation FROM c)
SELECT seq, generation, 't_' || tid || CASE WHEN generation > 0 THEN '_g' || generation ELSE '' END AS thread FROM g""",
    "flags_classify": f"""WITH {RECORDS} SELECT seq, CASE flags WHEN 'tr strt' THEN 'trace_begin' WHEN 'tr end call' THEN 'trace_end' WHEN 'async' THEN 'async_boundary' WHEN 'call' THEN 'call' WHEN 'return' THEN 'return' ELSE 'conditional' END AS kind,
  flags = 'tr strt' AS trace_begin, flags = 'tr end call' AS trace_end, flags = 'async' AS async_event, false AS "transaction", false AS interrupt, false AS syscall FROM rec""",
    "perf_time_parse": "SELECT event_id, nullif(event_id * 1000000000 + (event_id % 1000) * 1000000, 0) AS ns FROM events",
    "linkage_stem": "SELECT p_partkey, p_name || '::h' || lower(to_hex(p_partkey * 1000003)) AS name, CASE WHEN length(to_hex(p_partkey * 1000003)) >= 8 THEN p_name ELSE p_name || '::h' || lower(to_hex(p_partkey * 1000003)) END AS stem FROM part",
    "address_hex": "SELECT o_orderkey, '0x' || lower(to_hex(o_orderkey * 4099)) AS address, o_orderkey * 4099 AS parsed FROM orders",
    "namespaced_id": "SELECT 'a:' || o_orderstatus || ':sp' || o_orderkey AS id, 'a:' || o_orderstatus AS analysis, 'sp' AS kind, o_orderkey AS number FROM orders",
    "cache_key": "SELECT p_partkey, sha256(p_name || chr(0) || p_brand || chr(0) || p_size || chr(0)) AS key FROM part",
}
