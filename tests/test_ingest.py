"""From trace text to a published analysis, and queries over it."""

import pytest

from pathglass.errors import TraceError
from pathglass.operators import process
from pathglass.operators.locate import Images
from pathglass.plans.ingest import analyze, overlay, rebased, within_budget
from pathglass.plans.query import run_query
from pathglass.plans.request import parse_query
from pathglass.plans.store import Store
from pathglass.schemas import FUNCTIONS, IMAGES, INLINE_RANGES, RECORDS, SEGMENTS
from pathglass.sources.trace_text import read_trace_text

TEXT = """10/10 [000] 1.000000000: PERF_RECORD_COMM exec: perf-exec:10/10
10/10 [000] 1.100000000: PERF_RECORD_MMAP2 10/10: [0x1000(0x2000) @ 0 08:02 1 2]: r-xp /bin/launcher
10/10 [000] 1.200000000: PERF_RECORD_FORK(10:13):(10:10)
10/10 [000] 2.000000000: PERF_RECORD_COMM exec: prog:10/10
10/10 [000] 2.100000000: PERF_RECORD_MMAP2 10/10: [0x1000(0x2000) @ 0x100 08:02 1 2]: r-xp /bin/prog
10/10 [000] 2.200000000: PERF_RECORD_FORK(10:12):(10:10)
77/77 [000] 2.500000000: branches:u: call 1000 => 1100
10/13 [000] 2.600000000: branches:u: call 1000 => 1100
10/12 [000] 3.000000001: branches:u: tr strt jmp 0 => 1010
10/12 [000] 3.000000011: branches:u: call 1018 => 1100
10/12 [000] 3.000000021: branches:u: jmp 1108 => 1110
10/12 [000] 3.000000031: branches:u: call 1118 => 1200
10/12 [000] 3.000000041: branches:u: return 1208 => 1300
10/12 [000] 3.000000051: branches:u: return 1128 => 1020
10/12 [000] 3.000000061: branches:u: tr end 1028 => 0
10/12 [001] 3.000000101: branches:u: tr strt 0 => 1100
10/12 [001] 3.000000111: instructions:u: 1100 ilen: 2 insn: 74 0e
10/12 [001] 3.000000112: instructions:u: 1110 ilen: 2 insn: ff d0
10/12 [001] 3.000000113: instructions:u: 1200 ilen: 1 insn: 90
10/12 [001] 3.000000114: instructions:u: 1300 ilen: 1 insn: c3
PERF_RECORD_LOST lost 17
"""


@pytest.fixture(scope="module")
def images(spark):
    functions = [(1, "_main", "main", "i", 0x400000, 0x400080), (2, "helper", None, "i", 0x400100, 0x400180), (3, "leaf", None, "i", 0x400200, 0x400280)]
    frames = [("inner", "inner.c", 7), ("main", "main.c", 3)]
    return Images(
        spark.createDataFrame([("/bin/prog", "i", "b1")], IMAGES),
        spark.createDataFrame([("i", 0x100, 0x300, 0x400000)], SEGMENTS),
        spark.createDataFrame(functions, FUNCTIONS),
        spark.createDataFrame([("i", 0x400010, 0x400020, frames)], INLINE_RANGES),
    )


@pytest.fixture(scope="module")
def store(spark, images, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ingest")
    (folder / "t.txt").write_text(TEXT)
    s = Store(spark, f"file://{folder}/store")
    s.made = analyze(s, "a", read_trace_text(spark, f"{folder}/t.txt"), images, target="/opt/bin/prog")
    return s


def ask(store, **body):
    return run_query(store, parse_query(body))["data"]


def test_calls(store):
    rows = {(r["function"], r["start_ns"], r["end_ns"], r["completeness"]): r for r in ask(store, kind="timeline")}
    assert set(rows) == {("leaf", 30, 40, "complete"), ("helper", 10, 50, "complete"), ("main", 0, None, "interrupted_by_gap"), ("helper", 100, None, "open_both")}
    # The call from 0x1018 lies in an inlined part of main.
    assert rows["helper", 10, 50, "complete"]["call_site_inline"] == "inner" and rows["leaf", 30, 40, "complete"]["call_site_inline"] is None
    assert [r["path"] for r in ask(store, kind="hotpaths", group="path")][:2] == ["main/helper", "main/helper/leaf"]
    (thread,) = store.read("a", "threads").collect()
    assert (thread.id, thread.branch_count, thread.event_count, thread.span_count, thread.gap_count) == ("t_12", 8, 7, 4, 1)
    assert [tuple(s) for s in thread.segments] == [(0, 60), (100, 100)] and thread.covered_ns == 60
    assert [(g.kind, g.start_ns, g.end_ns, g.thread) for g in store.read("a", "gaps").orderBy("kind").collect()] == [("pt_loss", None, None, "t_unknown"), ("ring_truncation", 60, 100, "t_12")]


def test_quality_and_summary(store):
    quality = ask(store, kind="quality")
    assert quality == store.made["quality"] and quality["ring_truncation"] and quality["gaps_by_kind"] == {"pt_loss": 1, "ring_truncation": 1}
    n = quality["counters"]
    # The leaf's return lands in no function, so not astray; both samples of others are foreign.
    assert (n["lost_records"], n["foreign_samples"], n["foreign_pids"], n["ring_holes"], n["unwind_mismatches"], n["min_time_step_ns"]) == (1, 2, 2, 1, 0, 10)
    assert quality["incomplete_span_count"] == 2 and any("other processes" in note for note in quality["notes"])
    (summary,) = ask(store, kind="summary")
    assert summary["spans_count"] == 4 and summary["duration_ns"] == 100 and [a["id"] for a in summary["analyses"]] == ["a"]
    assert overlay({"gap_count": 9, "notes": []}, quality)["gap_count"] == 2


def test_instructions(store):
    rows = ask(store, kind="instructions")
    assert [(r["virt_ip"], r["kind"], r["outcome"], r["symbol"], r["image_offset"]) for r in rows] == [
        ("0x1100", "conditional", "taken", "helper", 0x400100), ("0x1110", "indirect_call", None, "helper", 0x400110), ("0x1200", "sequential", None, "leaf", 0x400200), ("0x1300", "return", None, None, 0x400)]
    sites = {r["site"]: r for r in ask(store, kind="branches")}
    assert sites["0x1100"]["taken_fraction"] == "1.000000" and sites["0x1110"]["indirect_targets"] == ["0x1200"]
    assert {r["symbol"]: r["instructions"] for r in ask(store, kind="inline_profile")} == {"helper": 2, "leaf": 1, None: 1}


def test_source(store):
    (row,) = ask(store, kind="source", address=0x1018)
    assert (row["path"], row["file_offset"], row["image_offset"], row["symbol"], row["inlined"]) == ("/bin/prog", 0x118, 0x400018, "main", "inner")
    (row,) = ask(store, kind="source", evidence="a:e3")
    assert (row["function"], row["image_offset"], row["file"]) == (1, 0x400018, "inner.c")


def test_budget_and_rebase(spark):
    rows = [{"stream": s, "seq": k, "record_type": "mmap" if k % 10 == 0 else "sample"} for s in (0, 1) for k in range(80)]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in RECORDS) for r in rows], RECORDS)
    assert within_budget(df, 200)[1] == 1
    kept, part = within_budget(df, 40)
    assert part == 4 and kept.filter("record_type = 'sample'").count() == 36 and kept.filter("record_type = 'mmap'").count() == 16
    with pytest.raises(TraceError) as e:
        within_budget(df, 1)
    assert e.value.code == "LIMIT_EXCEEDED"
    times = spark.createDataFrame([(5, 9), (7, None)], "start_ns long, end_ns long")
    assert sorted(map(tuple, rebased(times, 5, "start_ns", "end_ns").collect())) == [(0, 4), (2, None)]
    with pytest.raises(Exception):
        rebased(times, 6, "start_ns").collect()


def test_processes(spark):
    def task(seq, kind, pid, tid, ppid=None, comm=None):
        return {"seq": seq, "record_type": "task", "task_kind": kind, "pid": pid, "tid": tid, "ppid": ppid, "comm": comm, "time_ns": seq * 10}

    rows = [task(0, "comm", 1, 1, comm="perf-exec"), task(1, "fork", 1, 5, 1), task(2, "fork", 1, 6, 1), task(3, "exit", 1, 6), task(4, "fork", 2, 2, 1), task(5, "comm", 1, 1, comm="averyverylongna"), task(6, "fork", 3, 3, 1), task(7, "fork", 4, 4, 3), task(8, "fork", 9, 9, 8)]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in RECORDS) for r in rows], RECORDS)
    got = process.traced(df, target="/x/averyverylongname")
    # The child from before the program ran has not run it; the thread that has exited may come again.
    assert sorted(map(tuple, got.processes.collect())) == [(1, 5, 50), (3, 6, None), (4, 7, None)]
    assert [tuple(r) for r in got.excluded.collect()] == [(1, 5)]
    assert sorted(r.pid for r in process.traced(df, root_pid=8).processes.collect()) == [8, 9]
