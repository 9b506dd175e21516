"""Operators on small known inputs."""

import random

import pytest
from pyspark.sql import functions as F

from pathglass.operators import branches, call_paths, compare, hotpaths, records, symbols
from pathglass.operators.call_paths import row_rank
from pathglass.operators.quantiles import nearest_ranks
from pathglass.operators.self_time import self_times
from pathglass.operators.timeline import timeline
from pathglass.schemas import FUNCTIONS, INSTRUCTIONS, SPANS


@pytest.fixture
def spans(spark):
    def make(*rows):
        """(id, parent, start, end[, completeness[, function[, thread]]])"""
        full = []
        for i, parent, start, end, *more in rows:
            completeness, function, thread = (*more, *("complete", i, "t_1")[len(more) :])
            full.append((i, thread, function, parent, start, end, completeness, None, None, None))
        return spark.createDataFrame(full, SPANS)

    return make


@pytest.fixture
def names(spark):
    return lambda *pairs: spark.createDataFrame(list(pairs), "id long, name string")


@pytest.mark.parametrize("group", [50_000, 1])
@pytest.mark.parametrize("parent,children,want", [((0, 100), [(10, 20), (15, 30), (50, 60)], 70), ((0, 100), [], 100), ((0, 100), [(0, 100)], 0), ((0, 50), [(0, 10), (20, 30)], 30), ((10, 20), [(0, 5), (15, 40), (16, 16)], 5), ((10, 10), [(10, 12)], 0)])
def test_self_time(spans, group, parent, children, want):
    rows = spans((1, None, *parent), *((2 + k, 1, *c) for k, c in enumerate(children)))
    assert {r.id: r.self_ns for r in self_times(rows, group).collect()}[1] == want


def test_uncertain_children_leave_no_self_time(spans):
    rows = spans((1, None, 0, 100), (2, 1, 5, None, "open_end"), (3, None, 0, 9, "open_end"), (4, None, 0, 9), (5, 4, 1, None))
    assert {r.id: r.self_ns for r in self_times(rows).collect()} == {1: None, 4: None}


@pytest.mark.parametrize("values,want", [([10], (10, 10, 10)), ([1, 2, 3, 4], (2, 4, 4)), (list(range(1, 1001)), (500, 950, 990)), ([0, 0, 0, 5_000_000_000_000_000], (0, 5_000_000_000_000_000, 5_000_000_000_000_000)), ([None], None)])
def test_nearest_ranks(spark, values, want):
    df = spark.createDataFrame([("k", v) for v in values], "key string, value long")
    got = [(r.p50, r.p95, r.p99) for r in nearest_ranks(df, "key", (50, 95, 99)).collect()]
    assert got == ([] if want is None else [want])


def test_hotpaths_count_entries_and_calls(spans, names):
    rows = spans((1, None, 0, 10), (2, 1, 1, 2, "open_end"))
    got = {r.path: r for r in hotpaths.hotpaths(rows, names((1, "root"), (2, "child")), "path").collect()}
    assert got["root"].complete_calls == 1 and got["root/child"].complete_calls == 0
    assert got["root/child"].inclusive_sum_ns is None and got["root/child"].excluded_incomplete == 1
    clipped = hotpaths.hotpaths(spans((1, None, 0, 100)), names((1, "f")), start_ns=10, end_ns=20).first()
    assert (clipped.observed_entries, clipped.complete_calls) == (1, 0)


def test_p99_needs_a_thousand_calls(spans, names):
    few = hotpaths.hotpaths(spans(*((k, None, 0, k, "complete", 1) for k in range(10))), names((1, "f"))).first()
    assert few.p99 is None and few.p50 == 4
    many = hotpaths.hotpaths(spans(*((k, None, 0, k, "complete", 1) for k in range(1000))), names((1, "f"))).first()
    assert many.p99 == 989


def test_paths_of_deep_and_broken_forests(spans, names):
    chain = spans(*((k, k - 1 if k else None, 0, 1, "complete", 1) for k in range(80)), (200, 999, 0, 1, "complete", None))
    got = {r.id: r for r in call_paths.call_paths(chain, names((1, "f"))).collect()}
    assert got[5].path == "/".join(["f"] * 6) and got[5].depth == 5
    assert got[63].path == "/".join(["f"] * 64) and got[79].path == "/".join(["..."] + ["f"] * 64)
    assert got[200].path == "<unknown>" and len(got) == 81


def test_inline_chains(spark, names):
    rows = spark.createDataFrame([("t", 1, ["inner", "middle", "outer"], 4, 1, 10), ("t", 2, ["inner", "middle", "other"], 6, 1, 5)], "thread string, function long, chain array<string>, instructions long, blocks long, elapsed_ns long")
    names = names((1, "symbol_a"), (2, "symbol_b"))
    whole = {r.path: r.instructions for r in hotpaths.hotpaths_inline(rows, names).collect()}
    assert whole == {"symbol_a > outer > middle > inner": 4, "symbol_b > other > middle > inner": 6}
    found = hotpaths.hotpaths_inline(rows, names, depth=1, contains="inner").collect()
    assert sorted(r.path for r in found) == ["symbol_a > outer", "symbol_b > other"]
    assert [r.instructions for r in hotpaths.hotpaths_inline(rows, names, contains="symbol_a").collect()] == [4]


def test_at_instant(spans, names):
    rows = spans((1, None, 0, 100), (2, 1, 10, 50), (3, 2, 20, 30), (4, 1, 60, None, "open_end"))
    names = names((1, "main"), (2, "a"), (3, "b"), (4, "c"))
    at = lambda t: call_paths.at_instant(rows, names, t).first()
    assert (at(25).stack, at(25).elapsed_ns) == (["main", "a", "b"], 5)
    assert (at(70).stack, at(70).end_ns) == (["main", "c"], None)
    assert at(200).stack == ["main", "c"] and at(200).depth == 1
    assert call_paths.at_instant(rows.filter("id = 1"), names, 100).count() == 0


def test_timeline_bounds(spans, names):
    rows = spans((1, None, 10, 20), (2, None, 0, 0), (3, None, None, 5), (4, None, 19, None, "open_end"), (5, None, 30, 40))
    got = {r.id: r for r in timeline(rows, names((1, "f")), start_ns=4, end_ns=20).collect()}
    assert set(got) == {1, 3, 4} and not got[1].clipped and not got[3].clipped and not got[4].clipped
    assert {r.id: r.clipped for r in timeline(rows, names((1, "f")), start_ns=15, end_ns=19).collect()} == {1: True}
    assert 2 not in {r.id for r in timeline(rows, names((1, "f"))).collect()}
    assert {r.id for r in timeline(rows, names((1, "f")), min_duration_ns=10).collect()} == {1, 5}
    assert {r.id for r in timeline(rows, names((1, "f")), contains="f").collect()} == {1}


def hot(spark, *rows):
    return spark.createDataFrame([(*r, 1, 0) for r in rows], "path string, inclusive_sum_ns long, complete_calls long, excluded_incomplete long")


def test_compare(spark):
    b, c = hot(spark, ("root/foo::bar::h11111111", 100)), hot(spark, ("root/foo::bar::h22222222", 140))
    row = compare.compare_hotpaths(b, c).first()
    assert (row.match_kind, row.absolute_delta, row.relative_delta) == ("demangled_path", 40, 0.4)
    row = compare.compare_hotpaths(b, c, [("foo::bar::h11111111", "foo::bar::h22222222")]).first()
    assert (row.match_kind, row.absolute_delta, row.normalization) == ("explicit_pair", 40, "per_matched_path")
    row = compare.compare_hotpaths(b, c, allow_performance=False).first()
    assert (row.match_kind, row.absolute_delta, row.normalization) == ("demangled_path", None, "raw_selected_region")
    two = hot(spark, ("x/f::h11111111", 1), ("y/f::h22222222", 2))
    kinds = lambda df: sorted((r.path, r.match_kind, r.absolute_delta) for r in df.collect())
    assert kinds(compare.compare_hotpaths(hot(spark, ("z/f", 5)), two)) == [("x/f::h11111111", "ambiguous", None), ("y/f::h22222222", "ambiguous", None), ("z/f", "ambiguous", None)]
    assert kinds(compare.compare_hotpaths(two, hot(spark, ("z/f", 5)))) == [("x/f::h11111111", "ambiguous", None), ("y/f::h22222222", "ambiguous", None), ("z/f", "unmatched", None)]
    assert kinds(compare.compare_hotpaths(hot(spark, ("f", None)), hot(spark, ("f", 3)))) == [("f", "path", None)]
    checks = compare.comparable({"workload_fingerprint": "w", "cpu_model": 1, "dialect": "d"}, {"workload_fingerprint": "w", "cpu_model": 2, "dialect": "d"})
    assert checks == {"workload": True, "cpu": False, "events": True, "decoder": True}


def test_outcomes(spark):
    rows = [(0x10, "conditional", 0x20, 0x12), (0x12, "sequential", None, None), (0x10, "conditional", 0x20, 0x12), (0x20, "sequential", None, None), (0x10, "conditional", 0x20, 0x12), (None, None, None, None), (0x20, "conditional", 0x30, 0x30), (0x30, "conditional", 0x40, 0x32)]
    df = spark.createDataFrame([(1, 1, k, ip is None, ip, kind, t, f, k) for k, (ip, kind, t, f) in enumerate(rows)], "pid int, tid int, seq long, is_error boolean, ip long, kind string, branch_target long, fallthrough long, time_ns long")
    got = branches.outcomes(df).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["not_taken", None, "taken", None, "unknown", "unknown", "unknown"]
    assert [r.sequence for r in got] == [1, 2, 3, 4, 5, 7, 8]
    inside = branches.windowed_outcomes(df, 0, 3, slack_ns=1).orderBy("seq").collect()
    assert [r.outcome for r in inside] == ["not_taken", None, "taken"]


def test_branch_sites_and_profile(spark):
    row = lambda i, ip, kind, outcome=None, target=None, inlined=None: (i, "t", i, i, None, ip, "outer", inlined, None, 2, kind, target, None, outcome, None)
    rows = spark.createDataFrame([row(1, 0x104, "conditional", "taken"), row(2, 0x104, "conditional", "taken"), row(3, 0x104, "conditional", "not_taken"), row(4, 0x104, "conditional", "taken"), row(5, 0x200, "indirect_call"), row(6, 0x50, "sequential"), row(7, 0x200, "indirect_call", None, 0x99), row(8, 0x40, "sequential"), row(9, 0x200, "indirect_jump"), row(10, 0x50, "sequential"), row(11, 0x200, "indirect_call"), row(13, 0x70, "sequential"), row(14, 0x300, "indirect_jump")], INSTRUCTIONS)
    got = {r.site: r for r in branches.branch_sites(rows).collect()}
    assert (got["0x104"].taken, got["0x104"].not_taken, got["0x104"].taken_fraction) == (3, 1, "0.750000")
    # The thread goes on elsewhere behind the fourth call, and the last jump is the end: neither has a target.
    assert got["0x200"].indirect_targets == ["0x50", "0x40"] and got["0x200"].taken_fraction is None and set(got) == {"0x104", "0x200"}
    rows = spark.createDataFrame([row(k, 0x10 * k, "sequential", inlined="inner") for k in (1, 2, 3)] + [row(4, 0x90, "sequential")], INSTRUCTIONS)
    got = [(r.inlined, r.instructions, r.fraction, r.distinct_addresses) for r in branches.inline_profile(rows).orderBy(F.desc("instructions")).collect()]
    assert got == [("inner", 3, 0.75, 3), (None, 1, 0.25, 1)]


def test_symbols(spark):
    functions = spark.createDataFrame([("i", 1, "long", 0x100, 0x900), ("i", 2, "short", 0x200, 0x210), ("i", 3, "far", 0x500000, 0x500010)], "image_id string, id long, name string, start long, end long")
    probes = spark.createDataFrame([(k, "i", a) for k, a in enumerate([0x99, 0x100, 0x1FF, 0x20F, 0x210, 0x4FFFFF, 0x500000, 0x600000])], "id long, image_id string, address long")
    got = {r.id: r.symbol for r in symbols.symbolize(probes, functions).collect()}
    assert [got[k] for k in range(8)] == [None, "long", "long", "short", None, None, "far", None]
    maps = spark.createDataFrame([(1, 0x1000, 0x3000, 0, 0, "old"), (1, 0x2000, 1 << 44, 5, 1, "new"), (2, 0x1000, 0x2000, 0, 2, "other")], "pid int, start long, end long, seq long, generation long, path string")
    samples = spark.createDataFrame([(1, 1, 0x2500, 3), (2, 1, 0x2500, 6), (3, 1, 0x2500000, 9), (4, 2, 0x2500, 9), (5, 1, 0x2FFF, 4)], "id long, pid int, ip long, seq long")
    got = {r.id: r.path for r in symbols.map_addresses(samples, maps).collect()}
    assert got == {1: "old", 2: "new", 3: "new", 4: None, 5: "old"}
    segments = spark.createDataFrame([("i", 0x0, 0x100, 0x400000), ("i", 0x100, 0x50, 0x600000)], "image_id string, file_off long, file_size long, vaddr long")
    probes = spark.createDataFrame([(1, "i", 0x20), (2, "i", 0x120), (3, "i", 0x150)], "id long, image_id string, file_offset long")
    assert {r.id: r.address for r in symbols.file_offset_address(probes, segments).collect()} == {1: 0x400020, 2: 0x600020, 3: None}
    ranges = spark.createDataFrame([("i", 0, 100, [("outer", "a.c", 1)]), ("i", 10, 20, [("inner", "b.c", 2), ("outer", "a.c", 1)])], "image_id string, lo long, hi long, frames array<struct<function: string, file: string, line: int>>")
    rows = spark.createDataFrame([(1, "i", 15, "f"), (2, "i", 50, "outer"), (3, "i", 100, "f")], "id long, image_id string, address long, symbol string")
    assert {r.id: r.inlined for r in symbols.inline_frames(rows, ranges).collect()} == {1: "inner", 2: None, 3: None}


def test_records(spark):
    forks = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    tree = records.process_tree(forks, spark.createDataFrame([("a",)], "pid string"))
    assert dict(map(tuple, tree.collect())) == {"a": 0, "b": 1, "c": 2}
    one = spark.createDataFrame([("mmap", 0, 5), ("sample", 1, 10), ("sample", 2, 30)], "record_type string, seq long, time_ns long")
    two = spark.createDataFrame([("mmap", 0, 5), ("sample", 1, 20), ("sample", 2, 30)], "record_type string, seq long, time_ns long")
    merged = records.merge_streams([one, two]).orderBy("at", "stream", "seq").collect()
    assert [(r.at, r.stream) for r in merged] == [(5, 0), (10, 0), (20, 1), (30, 0), (30, 1)]
    points = spark.createDataFrame([("t", k, t, h) for k, (t, h) in enumerate([(0, False), (5, False), (9, True), (12, False)])], "thread string, seq long, time_ns long, hole boolean")
    assert sorted((r.start_ns, r.end_ns) for r in records.coverage_segments(points).collect()) == [(0, 5), (9, 12)]
    rebased = records.rebase(points, 4, "time_ns")
    assert [r.time_ns for r in rebased.orderBy("seq").collect()] == [0, 1, 5, 8]
    assert [r.time_ns for r in records.tail_window(points, 4).orderBy("seq").collect()] == [9, 12]


def test_function_schema_names_the_columns(spark):
    assert spark.createDataFrame([], FUNCTIONS).columns == ["id", "name", "demangled", "image_id", "start", "end"]


@pytest.mark.parametrize("group", [2, 7, 50_000])
def test_self_times_of_many_overlapping_children(spark, group):
    r = random.Random(23)
    rows = [(k, None, 1000 * k, 1000 * k + 900, "complete") for k in range(4)]
    for k in range(4):
        for _ in range((0, 1, 12, 60)[k]):
            start = 1000 * k + r.randint(-50, 900)
            rows.append((len(rows), k, start, start + r.choice([0, 5, 80, 700, 2000]), "complete"))
    df = spark.createDataFrame(rows, "id long, parent long, start_ns long, end_ns long, completeness string")
    got = {x.id: x.self_ns for x in self_times(df, group).collect()}
    for k in range(4):
        covered = {t for _, p, s, e, _ in rows if p == k for t in range(max(s, 1000 * k), min(e, 1000 * k + 900))}
        assert got[k] == 900 - len(covered)


def test_ranks_come_from_sorted_ranges(spark):
    df = spark.range(500).selectExpr("id", "pmod(id * 37, 101) as v")
    got = sorted(row_rank(df, F.desc("v"), "id").collect(), key=lambda x: x.ord)
    assert [x.ord for x in got] == list(range(1, 501))
    assert [(x.v, x.id) for x in got] == sorted(((x.v, x.id) for x in df.collect()), key=lambda x: (-x[0], x[1]))


def test_chains_meet_by_a_shuffle_at_every_size(spans, names, monkeypatch):
    plans, cut = [], call_paths.cut
    monkeypatch.setattr(call_paths, "cut", lambda df, what: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, what))[1])
    odd = ["a\x00b", "c\x01,d", "e/f", "\x01.", None]
    chain = spans(*((k, k - 1 if k else None, 0, 1, "complete", k % 5) for k in range(70)))
    got = {r.id: r for r in call_paths.call_paths(chain, names(*enumerate(odd))).collect()}
    shown = [x or "<unknown>" for x in odd] * 14
    assert [got[k].path for k in (0, 9, 63)] == ["/".join(shown[: k + 1]) for k in (0, 9, 63)]
    assert got[69].path == "/".join(["...", *shown[6:70]]) and (got[63].depth, got[64].depth, got[69].depth) == (63, 64, 64)
    assert len(plans) == 8 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans[1:])


def test_stacks_at_an_instant_double_like_they_climb(spans, names):
    r = random.Random(3)
    rows = [(k, r.choice([None, 999, *range(max(0, k - 2), k)]) if k < 100 else k - 1, k, r.choice([None, 500, 50]), "complete", k % 4, f"t_{r.randint(0, 2) if k < 100 else 3}") for k in range(180)]
    df, functions = spans(*rows), names((0, "a/b"), (1, "c\x00d"), (2, "e"))
    climbed, doubled = (sorted(map(tuple, call_paths.at_instant(df, functions, 190, few=few).collect())) for few in (1000, 0))
    assert doubled == climbed and [x[3] for x in doubled if x[0] == "t_3"] == [65]


def test_hotpaths_for_a_comparison_leave_self_times_out(spans, names):
    rows, functions = spans((1, None, 0, 10), (2, 1, 1, 2, "open_end"), (3, 1, 2, 4)), names((1, "a"), (2, "b"), (3, "c"))
    whole, lean = hotpaths.hotpaths(rows, functions), hotpaths.hotpaths(rows, functions, own=False)
    assert set(whole.columns) - set(lean.columns) == {"self_sum_ns", "p50", "p95", "p99"}
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, whole.select(lean.columns).collect()))


def test_self_times_meet_their_children_in_one_shuffle(spans):
    rows = spans((1, None, 0, 100), (2, 1, 10, 20), (3, 1, 15, 30))
    plan = self_times(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_time_beyond_a_long_leaves_the_rest_of_an_inline_profile(spark, names):
    rows = spark.createDataFrame([("t", k % 2, ["x"], 4, 1, (1 << 62) if k % 2 else 5) for k in range(6)], "thread string, function long, chain array<string>, instructions long, blocks long, elapsed_ns long")
    got = {r.path: (r.observed_entries, r.self_sum_ns, r.instructions) for r in hotpaths.hotpaths_inline(rows, names((0, "a"), (1, "b"))).collect()}
    assert got == {"a > x": (3, 15, 12), "b > x": (3, None, 12)}
