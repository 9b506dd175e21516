"""Call reconstruction: known cases, segments against one pass, streaming against batch, trace text."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathglass.operators import reconstruct
from pathglass.operators.reconstruct import CallStack
from pathglass.schemas import RECORDS
from pathglass.sources.trace_text import parse_records, parse_statistics, read_trace_text
from pathglass.streaming.call_stacks import READ, StackProcessor, StoredFrames, run_to_end, stream_stacks

FN = {0x10: 1, 0x20: 2, 0x30: 3, 0x40: 4}


@pytest.fixture
def records(spark):
    def make(*rows):
        """(flags, ip, addr[, time[, tid[, cpu]]]) samples, or dictionaries of other records."""
        full = []
        for seq, r in enumerate(rows):
            if not isinstance(r, dict):
                flags, ip, addr, *more = r
                time, tid, cpu = (*more, *((seq + 1) * 10, 1, 0)[len(more) :])
                r = {"record_type": "sample", "flags": flags, "ip": ip, "addr": addr, "time_ns": time, "tid": tid, "cpu": cpu, "event": "branches"}
            full.append({"stream": 0, "seq": seq, "pid": 1, "tid": 1} | r)
        df = spark.createDataFrame([tuple(r.get(f.name) for f in RECORDS) for r in full], RECORDS)
        of = lambda c: F.when((F.col(c) >= 0x10) & (F.col(c) < 0x100), F.shiftright(c, 4))
        return reconstruct.classify(df).withColumn("from_fn", of("ip")).withColumn("to_fn", of("addr"))

    return make


def shapes(df):
    return sorted(((r.function, r.start_ns, r.end_ns, r.completeness) for r in df.collect()), key=repr)


def test_nested_calls_and_a_return_too_many(records):
    spans, gaps = reconstruct.reconstruct(records(("call", 0x10, 0x20), ("call", 0x21, 0x30), ("return", 0x31, 0x22), ("return", 0x23, 0x11), ("return", 0x12, 0x40)))
    assert shapes(spans) == sorted([(3, 20, 30, "complete"), (2, 10, 40, "complete"), (1, None, 50, "uncertain_unwind"), (4, 50, None, "open_both")], key=repr)
    by = {r.function: r for r in spans.collect()}
    assert by[3].parent == by[2].id and by[2].parent is None and by[2].call_site == 0x10 and by[3].start_event == 1
    assert gaps.count() == 0


def test_interruptions_and_gaps(records):
    spans, gaps = reconstruct.reconstruct(records(("call", 0x10, 0x20), ("async", 0x21, 0x99), ("call", 0x30, 0x40)))
    assert shapes(spans) == sorted([(2, 10, None, "interrupted_by_gap"), (4, 30, None, "open_end")], key=repr)
    assert [(g.kind, g.start_ns) for g in gaps.collect()] == [("unknown", 20)]
    spans, gaps = reconstruct.reconstruct(records(("call", 0x10, 0x20, 10), ("call", 0x21, 0x30, 5)))
    assert [(g.kind, g.start_ns, g.end_ns, g.extent_known) for g in gaps.collect()] == [("time_regression", 10, 5, True)]
    assert (2, 10, None, "interrupted_by_gap") in shapes(spans)
    spans, gaps = reconstruct.reconstruct(records(("call", 0x10, 0x20), {"record_type": "decoder_error", "code": 5, "message": "m", "time_ns": 15, "tid": 2}, {"record_type": "decoder_error", "message": "n", "time_ns": 15}, {"record_type": "decoder_error", "message": "o", "pid": None}, {"record_type": "lost", "pid": None, "lost": 3}, ("return", 0x21, 0x11)))
    assert sorted(g.kind for g in gaps.collect()) == ["decoder_error", "decoder_error", "missing_image", "pt_loss"]
    assert {g.thread for g in gaps.collect()} == {"t_1", "t_2", "t_unknown"}
    assert (2, 10, None, "interrupted_by_gap") in shapes(spans)


def test_tracing_that_ends_and_resumes(records):
    spans, gaps = reconstruct.reconstruct(records(("call", 0x10, 0x20), ("tr end syscall", 0x21, 0), ("tr strt", 0, 0x22), ("return", 0x23, 0x11)))
    assert shapes(spans) == [(2, 10, 40, "complete")]
    assert [(g.kind, g.reason, g.extent_known) for g in gaps.collect()] == [("trace_boundary", "syscall", True)]
    spans, gaps = reconstruct.reconstruct(records(("call", 0x10, 0x20), ("tr end call", 0x21, 0), ("tr strt", 0, 0x30), ("return", 0x31, 0x11)))
    assert shapes(spans) == sorted([(2, 10, None, "interrupted_by_gap"), (3, 30, 40, "open_both")], key=repr)
    spans, gaps = reconstruct.reconstruct(records(("tr end", 0x21, 0), ("jmp", 0x22, 0x23)))
    assert [(g.kind, g.start_ns, g.end_ns) for g in gaps.collect()] == [("unknown", 10, 20)]
    moved = records(("call", 0x10, 0x20, 10, 1, 0), ("tr end", 0x21, 0, 20, 1, 0), ("tr strt", 0, 0x22, 40, 1, 3))
    assert [(g.kind, g.start_ns, g.end_ns) for g in reconstruct.reconstruct(moved)[1].collect()] == [("ring_truncation", 20, 40)]


def test_jumps(records):
    spans, _ = reconstruct.reconstruct(records(("call", 0x10, 0x20), ("jmp", 0x21, 0x30), ("return", 0x31, 0x11)))
    assert shapes(spans) == sorted([(2, 10, 20, "uncertain_unwind"), (3, 20, 30, "open_both")], key=repr)
    spans, _ = reconstruct.reconstruct(records(("call", 0x10, 0x900), ("jmp", 0x900, 0x30), ("return", 0x31, 0x11)))
    assert shapes(spans) == [(3, 10, 30, "complete")]
    plain = records(("call", 0x10, 0x20), *(("jcc", 0x21, 0x22) for _ in range(50)), ("return", 0x22, 0x11))
    assert [r.id for r in reconstruct.retained_events(plain).orderBy("id").collect()] == [0, 51]
    assert [(r.start_event, r.end_event) for r in reconstruct.reconstruct(plain)[0].collect()] == [(0, 51)]


def test_exits_start_new_generations(records):
    end = {"record_type": "task", "task_kind": "exit", "time_ns": 25}
    spans, _ = reconstruct.reconstruct(records(end, ("call", 0x10, 0x20), end, end, ("call", 0x10, 0x30)))
    assert sorted((r.thread, r.end_ns, r.completeness) for r in spans.collect() if r.thread == "t_1") == [("t_1", 25, "open_end")]
    assert [r.function for r in spans.collect() if r.thread == "t_1_g1"] == [3]


def noise(n, threads=3, seed=1, exits=True):
    r = random.Random(seed)
    words = ["call", "call", "call", "return", "return", "jcc", "jmp", "async", "tr end", "tr end syscall", "tr strt", "tr strt", "int", "syscall", ""]
    rows, t = [], 100
    for _ in range(n):
        t += r.choice([0, 1, 5, 5, 5, -3])
        tid = r.randint(1, threads)
        if r.random() < 0.03:
            rows.append({"record_type": "decoder_error", "code": r.choice([None, 5]), "message": "bad", "time_ns": t, "tid": tid})
        elif exits and r.random() < 0.02:
            rows.append({"record_type": "task", "task_kind": "exit", "time_ns": t, "tid": tid})
        else:
            rows.append((r.choice(words), r.choice([0x10, 0x20, 0x30, 0x900]), r.choice([0x10, 0x20, 0x30, 0x900]), max(1, t), tid, r.randint(0, 1)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_equal_one_pass_over_each_thread(records, seed):
    df = records(*noise(1500, seed=seed))
    prepared = reconstruct.prepare(reconstruct.with_event_ids(df).repartition(5)).collect()
    # One pass over all records of a thread, nothing dropped and nothing cut.
    full = reconstruct.with_event_ids(df).collect()
    kept = {r.seq: r for r in prepared}
    firsts = {}
    for r in sorted(full, key=lambda r: r.seq):
        if r.record_type == "sample" and r.time_ns is not None:
            firsts.setdefault(r.cpu, r.time_ns)
    stacks, state, out, sampled = {}, {}, [], set()
    for r in sorted(full, key=lambda r: r.seq):
        if r.record_type == "task" and r.tid not in stacks:
            continue
        last, generation = state.get(r.tid, (None, 0)) if r.tid in state else (None, 0)
        name = f"t_{r.tid}" + (f"_g{generation}" if generation else "")
        stack = stacks.setdefault(r.tid, CallStack(name)) if r.record_type != "task" else stacks[r.tid]
        row = r.asDict() | {"cpu_first_ns": firsts.get(r.cpu), "regressed_from": None}
        if r.record_type == "sample":
            if last is not None and r.time_ns < last:
                row["regressed_from"] = last
            state[r.tid] = (r.time_ns, generation)
            sampled.add(r.tid)
        stack.feed(tuple(row[c] for c in reconstruct.READ))
        if r.record_type == "task" and r.tid in sampled:
            sampled.remove(r.tid)
            out += stacks.pop(r.tid).out
            state[r.tid] = (None, generation + 1)
    for stack in stacks.values():
        stack.finish()
        out += stack.out
    spans, gaps = reconstruct.reconstruct(df)
    got = sorted(((r.thread, r.id, r.function, r.parent, r.start_ns, r.end_ns, r.completeness, r.start_event, r.end_event, r.call_site) for r in spans.collect()), key=repr)
    assert got == sorted(((o[1], *o[2:11]) for o in out if o[0] == "span"), key=repr)
    assert sorted(((g.thread, g.kind, g.start_ns, g.end_ns, g.reason) for g in gaps.collect()), key=repr) == sorted(((o[1], o[11], o[5], o[6], o[13]) for o in out if o[0] == "gap"), key=repr)
    assert len(kept) < len(full) and len({(r.tid, r.generation, r.segment) for r in prepared}) > 20


@pytest.mark.parametrize("seed", range(3))
def test_pieces_equal_whole_segments(spark, records, monkeypatch, seed):
    """Long segments cut at plain calls, where stacks, ends of tracing and errors reach over the cuts."""
    df = reconstruct.with_event_ids(records(*noise(1200, seed=100 + seed, threads=1 + seed % 2)))
    show = lambda: [sorted(map(tuple, t.collect()), key=repr) for t in reconstruct.reconstruct(df, counted=True)]
    whole = show()
    cuts = []
    monkeypatch.setattr(reconstruct, "LONG", 1)
    monkeypatch.setattr(reconstruct, "pieces", lambda rows, cut=reconstruct.pieces: cuts.append(cut(rows)) or cuts[-1])
    assert show() == whole
    assert cuts[0].select(*reconstruct.SEGMENT, "piece").distinct().count() > cuts[0].select(*reconstruct.SEGMENT).distinct().count()


def test_what_a_piece_leaves_over_is_its_effect_on_any_stack():
    """Plain values: a stack fed with all records, and one fed with what random pieces of them leave over."""
    for seed in range(300):
        r = random.Random(seed)
        rows, words = [], ["call"] * 6 + ["return"] * 6 + ["jump", "tail", "end", "begin", "begin", "async", "syscall", "error", "regressed"]
        for k in range(80):
            word, f = r.choice(words), lambda: r.choice([1, 2, 3, None])
            flags = {"end": (False, True), "begin": (True, False)}.get(word, (False, False))
            record = ["decoder_error" if word == "error" else "sample", 10 * k, r.choice([0, 0, 0, 1]), r.choice([0, 500]), None, "bad", 10 * k + 5 if word == "regressed" else None, k, f(), f(), 7]
            rows.append((*record, word if word in ("call", "return") else "jump", *flags, word == "async", False, False, word == "syscall"))
        whole = reconstruct.CallStack("t")
        for row in rows:
            whole.feed(row)
        whole.finish()
        fresh = [k for k in range(1, 80) if rows[k][11] == "call" and rows[k][0] == "sample" and not any(rows[k][12:]) and rows[k][6] is None and not next((x[13] for x in reversed(rows[:k]) if x[0] == "sample"), False)]
        cuts = sorted(r.sample(fresh, min(len(fresh), r.randint(1, 6))))
        below, out = reconstruct.CallStack("t"), []
        for a, b in zip([0, *cuts], [*cuts, 80], strict=True):
            piece = reconstruct.Piece("t")
            for row in rows[a:b]:
                piece.feed(row)
            piece.finish()
            out += piece.out
            for what, value in piece.left:
                below.feed(value) if what == "record" else below.mark(value) if what == "mark" else below.push(*value)
        below.finish()
        refs = {o[2]: o for o in below.out if o[0] == "ref"}
        given = [o for o in below.out if o[0] != "ref"]
        for *o, ref, target in out:
            if ref is not None:
                o[4] = refs[ref][4]
                o[14] = bool(o[14]) or (target is not None and refs[ref][3] is not None and refs[ref][3] != target)
            given.append(tuple(o))
        assert sorted(map(repr, given)) == sorted(map(repr, whole.out))


def test_streaming_equals_batch(spark, records, tmp_path):
    rows = noise(400, seed=3, exits=False) + [{"record_type": "task", "task_kind": "exit", "time_ns": 9999, "tid": t} for t in (1, 2, 3)]
    df = records(*rows).withColumn("cpu", F.lit(0)).withColumn("cpu_first_ns", F.lit(0).cast("long"))
    source = f"{tmp_path}/in"
    for k, (low, high) in enumerate(((0, 150), (150, 151), (151, 10_000))):
        df.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    got = run_to_end(stream_stacks(stream), f"file://{tmp_path}/out")
    spans, gaps = reconstruct.reconstruct(df)
    want = sorted(((r.thread, r.function, r.start_ns, r.end_ns, r.completeness, r.call_site) for r in spans.collect()), key=repr)
    assert sorted(((r.thread, r.function, r.start_ns, r.end_ns, r.completeness, r.call_site) for r in got.filter("row = 'span'").collect()), key=repr) == want
    assert sorted(((r.thread, r.kind, r.start_ns, r.reason) for r in got.filter("row = 'gap'").collect()), key=repr) == sorted(((r.thread, r.kind, r.start_ns, r.reason) for r in gaps.collect()), key=repr)
    # The tasks have exited: no frame is left in the state, and one row for each task.
    held = lambda name: spark.read.format("statestore").option("path", f"file://{tmp_path}/out/progress").option("stateVarName", name).load().count()
    assert held("frames") == 0 and held("head") == 3


def test_frames_in_state_are_read_as_needed():
    class State(dict):
        getValue, updateValue, read = dict.__getitem__, dict.__setitem__, 0

        def removeKey(self, key):
            del self[key]

    state = State({(k,): (k, k, k - 1, 0, k, "open_end", None) for k in range(50)})
    frames = StoredFrames(state, 50)
    stack = CallStack("t", frames)
    stack._open(900, 0, 7, 5, "open_end")
    assert len(frames) == 51 and frames[-1][2] == 49 and frames.below == 49
    for _ in range(3):
        frames.pop()
    assert frames.store() == 48 and len(state) == 48 and frames.below == 48
    stack.finish(9)
    assert frames.store() == 0 and not state and len(stack.out) == 48


TEXT = """# a comment

10/10 [002] 5.000000000: PERF_RECORD_COMM exec: prog:10/10
0/0 [002] 0.000000: PERF_RECORD_MMAP2 10/10: [0x1000(0x2000) @ 0x10 08:02 1 2]: r-xp /bin/a b
10/11 [002] 4.000000000: PERF_RECORD_FORK(10:12):(10:11)
10/12 [003] 6.000000001:  branches:u:   tr strt jmp                     0 =>     1234
10/12 [003] 6.000000002:  branches:u:   call                 1240 =>     1300 ilen: 5 insn: e8 f8 0c 00 00
10/12 6.000000003: instructions:u: call 1300 1240 ilen: 5 insn: e8 f8 0c 00 00
10/12 [003] 6.000000004: branches:u: 1310 1245 return
 instruction trace error type 1 time 7.5 cpu 3 pid 10 tid 12 ip 0x1400 code 5: Failed to get instruction
PERF_RECORD_LOST lost 17
10/12 [003] 8.0: PERF_RECORD_SWITCH_CPU_WIDE OUT
10/12 [003] 9.000000000: PERF_RECORD_EXIT(10:12):(10:12)
nonsense
10/12 [003] 6.5: PERF_RECORD_MMAP broken
"""


def test_trace_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text(TEXT)
    rows = read_trace_text(spark, f"{tmp_path}/t.txt").orderBy("seq").collect()
    assert [r.record_type for r in rows] == ["task", "mmap", "task", "sample", "sample", "sample", "sample", "decoder_error", "lost", "switch", "task", "decoder_error", "decoder_error"]
    comm, mmap, fork, start, call, insn, back, error, lost, switch, end, bad, broken = rows
    assert (comm.task_kind, comm.comm, comm.pid, comm.time_ns) == ("comm", "prog", 10, 5_000_000_000)
    assert (mmap.pid, mmap.start, mmap.len, mmap.pgoff, mmap.prot, mmap.path, mmap.time_ns) == (10, 0x1000, 0x2000, 0x10, "r-xp", "/bin/a b", None)
    assert (fork.task_kind, fork.pid, fork.tid, fork.ppid, fork.ptid) == ("fork", 10, 12, 10, 11)
    assert (start.ip, start.addr, start.flags, start.cpu) == (0, 0x1234, "tr strt jmp", 3)
    assert (call.ip, call.addr, call.flags, call.insn_len, call.insn) == (0x1240, 0x1300, "call", 5, "e8 f8 0c 00 00")
    assert (insn.event, insn.ip, insn.addr, insn.cpu) == ("instructions", 0x1240, 0x1300, None)
    assert (back.ip, back.addr, back.flags) == (0x1310, 0x1245, "return")
    assert (error.pid, error.tid, error.cpu, error.ip, error.code, error.time_ns) == (10, 12, 3, 0x1400, 5, 7_500_000_000)
    assert lost.lost == 17 and switch.switch_out and (end.task_kind, end.tid) == ("exit", 12)
    assert bad.message == "nonsense" and bad.pid is None and broken.pid == 10
    stats = parse_statistics(read_trace_text(spark, f"{tmp_path}/t.txt")).first()
    assert (stats.records, stats.samples, stats.unparsed) == (13, 4, 2)
    assert parse_records(spark.createDataFrame([], "stream int, seq long, value string")).count() == 0


def test_numbered_records_are_written_once_and_busy_threads_counted_first(spark, records, monkeypatch):
    """Two streams: their order is not computed for each reader, and segments are not counted where no thread is long."""
    written, write = [], reconstruct.cut
    monkeypatch.setattr(reconstruct, "cut", lambda df, what: (written.append(what), write(df, what))[1])
    rows = records(*[("call", 0x10, 0x20), ("return", 0x21, 0x11)] * 6).withColumn("stream", (F.col("seq") % 2).cast("int"))
    spans, _ = reconstruct.reconstruct(rows)
    assert {r.completeness for r in spans.collect()} == {"complete"} and spans.count() == 6
    assert written.count("numbered") == 1 and "long-segments" not in written
    monkeypatch.setattr(reconstruct, "LONG", 12)
    assert sorted(map(tuple, reconstruct.reconstruct(rows)[0].collect())) == sorted(map(tuple, spans.collect())) and "long-segments" in written


def test_a_batch_is_fed_by_columns(monkeypatch):
    """No dictionary for each record; nulls, order and long integers are kept."""
    processor, head, frames = StackProcessor(), [], {}
    processor.head = type("Head", (), {"exists": lambda self: bool(head), "get": lambda self: head[-1], "update": lambda self, x: head.append(x)})()
    processor.frames = type("Frames", (), {"getValue": lambda self, k: frames[k], "updateValue": lambda self, k, v: frames.update({k: v}), "removeKey": lambda self, k: frames.pop(k)})()
    monkeypatch.setattr(pd.DataFrame, "to_dict", lambda *_: pytest.fail("a dictionary for each record"))
    late = 2**60 + 1
    rows = [("sample", 2, str(late), None, 2.0, 1.0, 33, "return"), ("sample", 1, str(late - 1), None, 1.0, 2.0, 16, "call"), ("sample", 3, None, None, None, 3.0, 34, "call")]
    batch = pd.DataFrame([(t, seq, now, 0, first, None, None, a, b, str(ip), kind, *[False] * 6) for t, seq, now, first, a, b, ip, kind in rows], columns=READ)
    (out,) = processor.handleInputRows((1, 7), iter([batch[:1], batch[1:]]), None)
    assert out[["row", "thread", "key", "function", "start_ns", "end_ns", "completeness"]].values.tolist() == [["span", "t_7", 2, 2.0, late - 1, late, "complete"]]
    assert frames == {(0,): (6, 3, None, None, 3, "open_end", 34)} and head[-1][:5] == (0, True, late, 1, False)
