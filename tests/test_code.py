"""Bytes of images: the decoder, pages, instruction rows, inline attribution, merged streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathglass.functions import x86
from pathglass.operators import code, instructions, reconstruct, records
from pathglass.operators.locate import Images
from pathglass.schemas import FUNCTIONS, IMAGES, INLINE_RANGES, RECORDS, SEGMENTS
from pathglass.sources import star


def decode(text):
    length, kind, targeted, displacement = x86.decode(*x86.windows([bytes.fromhex(text)]))
    return int(length[0]), x86.KINDS[kind[0]], int(length[0] + displacement[0]) if targeted[0] else None


@pytest.mark.parametrize(
    "text,length,kind,target",
    [
        ("75 0e", 2, "conditional", 0x10),
        ("0f 84 00 01 00 00", 6, "conditional", 0x106),
        ("e8 fb ff ff ff", 5, "call", 0),
        ("eb fe", 2, "jump", 0),
        ("e3 05", 2, "conditional", 7),
        ("c3", 1, "return", None),
        ("f3 c3", 2, "return", None),
        ("c2 08 00", 3, "return", None),
        ("48 cf", 2, "return", None),
        ("ff d0", 2, "indirect_call", None),
        ("41 ff e3", 3, "indirect_jump", None),
        ("ff 25 11 22 33 44", 6, "indirect_jump", None),
        ("48 89 e7", 3, "sequential", None),
        ("0f 05", 2, "call", None),
        ("cc", 1, "other", None),
        ("0f 0b", 2, "other", None),
        ("f2 e9 00 00 00 00", 6, "jump", 6),
        ("66 0f 1f 84 00 00 00 00 00", 9, "sequential", None),
        ("48 b8 01 02 03 04 05 06 07 08", 10, "sequential", None),
        ("66 b8 01 02", 4, "sequential", None),
        ("48 c7 44 24 08 01 00 00 00", 9, "sequential", None),
        ("66 c7 44 24 08 01 00", 7, "sequential", None),
        ("f6 c1 01", 3, "sequential", None),
        ("f6 d1", 2, "sequential", None),
        ("f7 c1 01 00 00 00", 6, "sequential", None),
        ("a1 01 02 03 04 05 06 07 08", 9, "sequential", None),
        ("67 a1 01 02 03 04", 6, "sequential", None),
        ("c8 10 00 01", 4, "sequential", None),
        ("8b 05 01 02 03 04", 6, "sequential", None),
        ("8b 04 25 01 02 03 04", 7, "sequential", None),
        ("66 0f 3a 0f c1 08", 6, "sequential", None),
        ("0f 38 f0 06", 4, "sequential", None),
        ("c5 f8 77", 3, "sequential", None),
        ("c5 f9 70 c0 1b", 5, "sequential", None),
        ("c4 e2 7d 18 05 01 02 03 04", 9, "sequential", None),
        ("c4 e3 7d 19 c1 01", 6, "sequential", None),
        ("62 f1 7c 48 10 44 24 01", 8, "sequential", None),
        ("62 f3 75 48 25 c0 ff", 7, "sequential", None),
        ("8f e9 78 81 c0", 5, "sequential", None),
        ("8f 00", 2, "sequential", None),
        ("0f 20 c0", 3, "sequential", None),
        ("06", 0, "other", None),
        ("48", 0, "other", None),
        ("e8 01 02", 0, "other", None),
        ("66 " * 14 + "90", 15, "sequential", None),
        ("66 " * 15 + "90", 0, "other", None),
    ],
)
def test_lengths_and_kinds(text, length, kind, target):
    assert decode(text) == (length, kind, target)


def test_instructions_of_a_block():
    body = bytes.fromhex("90 4889e5 e800000000 ffd0 06 90")
    blocks = [body, body, body, body, b"", body[:1]]
    assert x86.count_instructions(blocks, np.array([0, 4, 9, 12, 3, 5])).tolist() == [1, 3, 4, 4, 0, 1]


def rows_of(spark, *dicts):
    return spark.createDataFrame([tuple({"stream": 0, "pid": 1, "tid": 1, **d}.get(f.name) for f in RECORDS) for d in dicts], RECORDS)


def test_pages_and_bytes_over_their_borders(spark, tmp_path):
    r = random.Random(2)
    content = {"a": bytes(r.randbytes(3 * code.PAGE + 7)), "b": b"xyz", "empty": b""}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    images, pages = code.read_images(spark, f"file://{tmp_path}")
    ids = {"empty": "none"} | {row.path.rsplit("/", 1)[-1]: row.image_id for row in images.collect()}
    assert sorted(map(tuple, pages.groupBy("image_id").count().collect())) == sorted([(ids["a"], 4), (ids["b"], 1)])
    asked = [("a", 0, 5), ("a", code.PAGE - 3, 10), ("a", code.PAGE - 1, 2 * code.PAGE + 5), ("a", 3 * code.PAGE + 5, 15), ("a", 3 * code.PAGE + 7, 4), ("a", -1, 4), ("b", 1, 15), ("b", 9, 1), ("empty", 0, 3), ("a", 4, 0)]
    places = spark.createDataFrame([(k, ids[n], at, size) for k, (n, at, size) in enumerate(asked)], "id long, image_id string, at long, n long")
    got = {row.id: row.bytes for row in code.read_bytes(places, pages).collect()}
    want = {k: bytes(content[n][at : at + size]) if at >= 0 and size else b"" for k, (n, at, size) in enumerate(asked)}
    assert {k: bytes(v or b"") for k, v in got.items()} == want


def brute_instructions(rows):
    """(thread, sequence, next ip unless an error lies between) of every instruction sample, in one pass over all records."""
    sequence, pending, exited, generation, out = {}, {}, set(), {}, []
    for row in rows:
        key = (row.get("pid"), row.get("tid"))
        kind = row["record_type"]
        if kind == "task":
            exited.add(key)
        elif kind == "decoder_error":
            for k in [key] if None not in key else list(sequence):
                if k in pending:
                    out[pending.pop(k)][2] = None
                if k in sequence:
                    sequence[k] += 1
        else:
            sequence[key] = sequence.get(key, 0) + 1
            if key in pending:
                out[pending.pop(key)][2] = row["ip"]
            if key in exited:
                exited.remove(key)
                generation[key] = generation.get(key, 0) + 1
                sequence[key] = 1
            g = generation.get(key, 0)
            pending[key] = len(out)
            out.append([f"t_{key[1]}" + (f"_g{g}" if g else ""), sequence[key], None])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_sequences_across_errors_and_exits(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(400):
        pid, tid = r.choice([(1, 1), (1, 2), (2, 3), (2, 1)])
        kind = r.choice(["sample"] * 12 + ["decoder_error", "decoder_error", "task", "task"])
        row = {"seq": k, "record_type": kind, "pid": pid, "tid": tid}
        if kind == "sample":
            row |= {"event": "instructions", "ip": r.randint(1, 9)}
        elif kind == "task":
            row |= {"task_kind": "exit"}
        elif r.random() < 0.4:
            row |= {"pid": None} if r.random() < 0.5 else {"tid": None}
        rows.append(row)
    df = reconstruct.with_event_ids(rows_of(spark, *rows))
    got = instructions.sequenced(df).orderBy("seq").collect()
    ended = lambda x: None if x.next_lost else x.next_ip
    assert [(x.thread, x.sequence, ended(x)) for x in got] == brute_instructions(rows)


@pytest.fixture(scope="module")
def images(spark):
    content = bytes.fromhex("90" * 0x10 + "7402 90 4889e5 e800000000 ffd0 c3 eb90".replace(" ", "")) + bytes.fromhex("90" * 0x20)
    frames = [("inner", "a.c", 1), ("outer", "a.c", 2), ("f", "a.c", 3)]
    return Images(
        spark.createDataFrame([("/bin/x", "x", "b"), ("/bin/bare", "bare", "b")], IMAGES),
        spark.createDataFrame([("x", 0x10, 0x20, 0x400000)], SEGMENTS),
        spark.createDataFrame([(1, "f", "f", "x", 0x400000, 0x400020)], FUNCTIONS),
        spark.createDataFrame([("x", 0x400002, 0x400006, frames)], INLINE_RANGES),
        code.code_pages(spark.createDataFrame([("x", bytearray(content))], "image_id string, content binary")),
    )


MMAPS = [
    {"seq": 0, "record_type": "mmap", "start": 0x1000, "len": 0x40, "pgoff": 0, "path": "/bin/x"},
    {"seq": 1, "record_type": "mmap", "start": 0x9000, "len": 0x40, "pgoff": 0, "path": "/bin/bare"},
]


def test_stated_bytes_and_those_of_the_image_agree(spark, images):
    line = "74 02 90 48 89 e5 e8 00 00 00 00 ff d0 c3 eb"
    run = [0x1010, 0x1012, 0x1013, 0x1016, 0x1010, 0x1014, 0x101B, 0x101D, 0x101E, 0x9000, 0x103F, 0x1010]
    sample = lambda k, ip, insn: {"seq": 10 + k, "record_type": "sample", "event": "instructions", "time_ns": k, "ip": ip, "insn": insn}
    from_image = instructions.instruction_rows(rows_of(spark, *MMAPS, *(sample(k, ip, None) for k, ip in enumerate(run))), images)
    got = {x.id - 10: x for x in from_image.collect()}
    shown = [(got[k].kind, got[k].len, got[k].branch_target, got[k].fallthrough, got[k].outcome, got[k].symbol, got[k].inlined) for k in range(len(run))]
    assert shown == [
        ("conditional", 2, 0x1014, 0x1012, "not_taken", "f", None),
        ("sequential", 1, None, 0x1013, None, "f", "inner"),
        ("sequential", 3, None, 0x1016, None, "f", "inner"),
        ("call", 5, 0x101B, 0x101B, None, "f", None),
        ("conditional", 2, 0x1014, 0x1012, "taken", "f", None),
        ("sequential", 2, None, 0x1016, None, "f", "inner"),
        ("indirect_call", 2, None, 0x101D, None, "f", None),
        ("return", 1, None, None, None, "f", None),
        ("jump", 2, 0x1020 - 0x70, 0x1020, None, "f", None),
        ("other", 0, None, None, None, None, None),
        ("sequential", 1, None, 0x1040, None, None, None),
        ("conditional", 2, 0x1014, 0x1012, "unknown", "f", None),
    ]
    assert got[0].bytes_hex == line and got[9].bytes_hex == "" and got[10].bytes_hex == "90"
    stated = {0x1010: "74 02", 0x1012: "90", 0x1013: "48 89 e5", 0x1016: "e8 00 00 00 00", 0x1014: "89 e5", 0x101B: "ff d0", 0x101D: "c3", 0x101E: "eb 90", 0x103F: "90"}
    mixed = rows_of(spark, *MMAPS, *(sample(k, ip, stated.get(ip) if k % 2 else None) for k, ip in enumerate(run)))
    for other in (mixed, rows_of(spark, *MMAPS, *(sample(k, ip, stated.get(ip)) for k, ip in enumerate(run)))):
        again = {x.id - 10: x for x in instructions.instruction_rows(other, images).collect()}
        assert [(again[k].kind, again[k].len, again[k].branch_target, again[k].fallthrough, again[k].outcome, again[k].symbol, again[k].inlined) for k in range(len(run))] == shown
    # A window's last conditional is decided by what runs behind it.
    inside = instructions.instruction_rows(mixed, images, start_ns=4, end_ns=5).collect()
    assert [(x.virt_ip, x.outcome) for x in inside] == [(0x1010, "taken")]
    blind = instructions.instruction_rows(mixed, images._replace(code=None)).filter("id = 10").first()
    assert (blind.kind, blind.len, blind.bytes_hex) == ("other", 0, "")


def test_blocks_go_to_inline_chains(spark, images):
    jump = lambda k, ip, addr, t, flags="jmp", tid=1: {"seq": k, "record_type": "sample", "event": "branches", "tid": tid, "time_ns": t, "ip": ip, "addr": addr, "flags": flags}
    rows = rows_of(
        spark, *MMAPS,
        jump(2, 0x9000, 0x1010, 10), jump(3, 0x101E, 0x1012, 25),  # 74 90 48 e8 ff c3 eb: seven
        jump(4, 0x1013, 0x1012, 30), jump(5, 0x101E, 0x9004, 29),  # inlined: two, then six; time runs backwards
        jump(6, 0x9008, 0, 40), jump(7, 0x1014, 0x1010, 50),  # no bytes known; no target
        jump(8, 0x1011, 0x1016, 60, "tr end"), jump(9, 0x101B, 0x1010, 70, "tr strt"),  # tracing ended; begins
        {"seq": 10, "record_type": "task", "task_kind": "exit"}, jump(11, 0x1020, 0x103F, 80), jump(12, 0x1040, 0x1010, 90),  # exit; leaves the mapping
        jump(13, 0x1000, 0x1010, 5, tid=2), jump(14, 0x1010, 0x1020, 8, tid=2), jump(15, 0x1010, 0x1010, 9, tid=2), jump(16, 0x1012, 0x1, 19, tid=2),  # backwards
    )
    names = spark.createDataFrame([(1, 2, "t_2_g1")], "pid int, tid int, thread string")
    got = code.inline_rows(reconstruct.classify(reconstruct.with_event_ids(rows)), records_mappings(rows), images, names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [("t_1", 1, [], 7 + 1, 2, 15 + 10), ("t_1", 1, ["inner", "outer"], 2 + 6, 2, 5), ("t_2_g1", 1, [], 1 + 2, 2, 3 + 10)], key=repr)


def records_mappings(rows):
    from pathglass.operators.locate import mappings_of

    return mappings_of(rows)


def brute_merge(streams):
    """Heads taken by (time, stream), as they come."""
    heads, out = [list(s) for s in streams], []
    while any(heads):
        _, i = min((h[0].get("time_ns") or 0, i) for i, h in enumerate(heads) if h)
        row = heads[i].pop(0)
        if i == 0 or row["record_type"] not in records.SIDE_RECORDS:
            out.append((i, row["seq"]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_streams_are_merged_as_their_heads_come(spark, seed):
    r = random.Random(seed)
    streams = []
    for s in range(3):
        t, rows = 100, []
        for k in range(60):
            t += r.choice([0, 1, 5, -20])
            rows.append({"stream": s, "seq": k, "record_type": r.choice(["sample"] * 6 + ["mmap", "lost", "decoder_error"]), "time_ns": None if r.random() < 0.1 else t, "addr": k})
        streams.append(rows)
    merged = records.in_ranges(rows_of(spark, *(row for s in streams for row in s)))
    got = [(x.stream, x.addr) for x in merged.orderBy("seq").collect()]
    assert got == brute_merge(streams)
    assert [x.seq for x in merged.orderBy("seq").collect()] == list(range(len(got)))
    assert merged.orderBy("seq").select("part").collect() == merged.orderBy("part", "seq").select("part").collect()
    one = records.in_ranges(rows_of(spark, *streams[1]).filter(F.col("time_ns").isNotNull()))
    assert sorted(x.seq for x in one.collect()) == sorted(row["seq"] for row in streams[1] if row["time_ns"] is not None)


@pytest.mark.parametrize("source", [star.executed, star.executed_with_exits, star.records_of_processes])
def test_an_events_type_comes_along_with_its_record(spark, source):
    assert "Join" not in source(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_rows_take_their_other_columns_through_decoding(spark):
    rows = spark.createDataFrame([(1, "74 0e", 5), (2, None, 6), (3, "c3", None)], "id long, insn string, thread long")
    out = instructions.instruction_code(rows, spark.createDataFrame([], "id long, image_id string, file_offset long"), None)
    assert sorted((r.id, r.thread, r.kind) for r in out.collect()) == [(1, 5, "conditional"), (2, 6, None), (3, None, "return")]
