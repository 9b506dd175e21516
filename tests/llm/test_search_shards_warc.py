"""M-tree search, ring sharding, WARC (operators 1, 2, 9)."""

import base64
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from pathglass.llm import mtree, ring_shards, warc


def brute_top_k(rows, every, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, v) for i, v in usable if sum(x * x for x in v) < 1 << 62]
    out = []
    for q, x in dict((i, v) for i, v in usable if i % every == 0).items():
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in usable if i != q and len(x) == len(y))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("root,block", [(1, 10_000), (4, 40), (16, 25)])
def test_top_k_equals_brute_force(spark, root, block):
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.gauss(i % 3, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties: one very common vector
    rows += [(2000, None), (2050, []), (2100, [None] * 6), (2150, [math.nan] * 6), (2200, [math.inf] * 6), (2250, [0.0] * 6), (None, [1.0] * 6), (2300, [1.0, 2.0]), (2301, [2.0, 1.0]), (2350, [1e300, 1.0]), (2400, [3e7] * 6)]
    rows += [(2500, [0.5] * 6)] * 4 + [(2501, [0.5] * 6)] * 9  # repeated ids
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, cell string")
    got = mtree.top_k(df, every=50, k=5, root=root, block=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top_k(rows, 50, 5)


@pytest.mark.parametrize("root,block", [(1, 10_000), (8, 10)])
def test_ids_that_repeat_with_many_vectors(spark, root, block):
    """An id's own rows, however many, take no place of others; as candidates each counts."""
    r = random.Random(6)
    vector = lambda far: [float(r.randint(-8, 8)) + far for _ in range(4)]
    rows = [(50, vector(3.0)) for _ in range(12)] + [(i, vector(0.0)) for i in range(1, 40)] + [(7, vector(4.0)) for _ in range(30)] + [(100, v := vector(3.0)), (150, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, mtree.top_k(df, root=root, block=block).select("query_id", "rank", "vec_id", "score").collect()))
    scaled = [(i, [256 * int(c) for c in v]) for i, v in rows]
    want = []
    for q in (50, 100, 150):
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for j, x in scaled if j == q for i, y in scaled if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)]
    assert got == want


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema)).count() == 0
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in mtree.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()] == [(0, 1, 1, 131072)]


def test_tree_prunes_and_stays_exact():
    r = np.random.default_rng(1)
    x = np.floor(256 * (r.normal(size=(4000, 8)) * 0.05 + r.integers(0, 6, (4000, 1)))).astype(np.int64)
    space = mtree.Space(int((x * x).sum(1).max()))
    tree = mtree.MTree(x, np.arange(4000), space)
    computed = []
    for q in range(0, 4000, 500):
        want = sorted(((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q))[:5]
        before = tree.computed
        assert [t for t in tree.search(x[q], 6, None) if t[1] != q][:5] == [(-s, i) for s, i in want]
        computed.append(tree.computed - before)
    # Of 4000 rows and the nodes above them; a query near the origin tells no row from another.
    assert sorted(computed)[4] < 2_000
    routes, rows = mtree.Root(list(x[:200]), space), x[200:]
    cell, apart = routes.cells(rows)
    assert np.allclose(apart, [np.sqrt(((space.rows(v[None])[0] - routes.routes[8][1][c]) ** 2).sum()) for v, c in zip(rows, cell, strict=True)])


def test_ring_shards_follow_the_law(spark, frame, prose):
    rows = [*prose, *((500 + k, "same text") for k in range(90)), *((None, "no id") for _ in range(7)), (3, "again"), (3, "again")]
    got = ring_shards.assign_shards(frame(rows), shards=5, replicas=4).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(k, [])) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = ring_shards.assign_shards(frame(rows).repartition(7), shards=5, replicas=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert ring_shards.assign_shards(frame([])).count() == 0


def test_shards_equal_a_walk_around_the_ring(spark, frame, prose):
    """Row by row: the home shard, or the next ones clockwise with room, within the bounds."""
    rows = [*prose, *((500 + k, f"text {k % 7}") for k in range(200))]
    shards, replicas = 5, 4
    got = ring_shards.assign_shards(frame(rows), shards=shards, replicas=replicas).collect()
    arcs = {}
    for x in ring_shards.ring(spark, shards, replicas).collect():
        arcs[x.cell] = (x.arc, x.shard)
    order = sorted({a for a in arcs.values()})
    cell = {(x.doc_id, x.text): (x.cell, x.h) for x in frame(rows).selectExpr("doc_id", "text", "cast(pmod(xxhash64(doc_id, text), 65536) as int) as cell", "xxhash64(doc_id, text) as h").collect()}
    bounds = [len(rows) // shards + (k < len(rows) % shards) for k in range(shards)]
    # All take what fits at home first, arc by arc; then the rest walks on, arc by arc.
    by_arc = {a: [] for a, _ in order}
    for row in sorted(rows, key=lambda r: (cell[r], r[0] is not None, r[0])):
        by_arc[arcs[cell[row][0]][0]].append(row)
    first, wrap = order[0][0], [r for r in by_arc[order[0][0]] if cell[r][0] > order[0][0]]
    by_arc[first] = [r for r in by_arc[first] if r not in wrap] + wrap
    want, loads, left = {}, [0] * shards, []
    for k, (arc, shard) in enumerate(order):
        for row in by_arc[arc]:
            if loads[shard] < bounds[shard]:
                loads[shard] += 1
                want[row] = shard
            else:
                left.append((k, row))
    for k, row in left:
        shard = next(s for _, s in order[k + 1 :] + order[: k + 1] if loads[s] < bounds[s])
        loads[shard] += 1
        want[row] = shard
    assert {(g.doc_id, g.text_crc32): g.shard for g in got} == {(i, zlib.crc32((t or "").encode())): s for (i, t), s in want.items()}


def test_most_rows_stay_at_their_home_on_the_ring(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = ring_shards.assign_shards(docs, shards=6, replicas=64)
    cell = "cast(pmod(xxhash64(doc_id, text), 65536) as int)"
    home = ring_shards.ring(spark, 6, 64).withColumnRenamed("shard", "home")
    joined = docs.selectExpr("doc_id", f"{cell} as cell").join(home, "cell").join(got.select("doc_id", "shard"), "doc_id")
    assert home.count() == ring_shards.CELLS
    assert joined.filter("home = shard").count() > 3200


def test_warc_round_trip(spark):
    r = random.Random(6)
    pages = [(k, f"http://x/{k}", "".join(r.choice("<a>é \r\n") for _ in range(r.randint(0, 400)))) for k in range(50)]
    pages += [(60 + k, "http://copy", "<p>same\r\n\r\n</p>") for k in range(40)] + [(200, None, None), (201, "u\r\nv", ""), (None, "n", "no id"), (202, "n", "no id"), (None, "m", "alone"), (203, "b", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, refers_to string, payload string")
    got = warc.warc_round_trip(df).collect()
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        body, top = (h or "").encode(), best[h or ""]
        revisit = top >= 0 and i != top
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    path, out = warc.new_path(spark, "warc-test"), warc.new_path(spark, "warc-files")
    warc.write_archives(warc.plan_records(df), path, archive_bytes=2_000)
    files = warc.export_archives(spark, path, out).collect()
    assert len(files) > 3 and sum(f.n_records for f in files) == len(pages)
    seen = []
    for f in files:
        data = Path(out.removeprefix("file://"), f.name).read_bytes()
        assert len(data) == f["size"]
        seen += list(warc.read_archive(data))
    assert len({r.headers["WARC-Record-ID"] for r in seen}) == len(pages)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.headers["WARC-Date"]) for r in seen)
    small = {tuple(x) for x in warc.warc_round_trip(df, min_bytes=10).select("payload_bytes", "record_type").collect()}
    assert all(size >= 10 or kind == "response" for size, kind in small)


def test_reader_checks_framing_and_digests():
    good = warc.record_bytes("response", 1, "u", b"payload") + warc.record_bytes("revisit", 2, "u", b"payload", 1)
    kinds = [(r.kind, r.payload) for r in warc.read_archive(good)]
    assert kinds == [("response", b"payload"), ("revisit", b"")]
    with pytest.raises(ValueError):
        list(warc.read_archive(good[:-5]))
    plain = b"".join(warc._members(warc.record_bytes("response", 1, "u", b"payload")))
    pack = lambda data: (z := zlib.compressobj(4, zlib.DEFLATED, 31)).compress(data) + z.flush()
    for broken in (plain.replace(b"payload\r\n", b"paylxxd\r\n"), plain.replace(b"Content-Length: ", b"Content-Length: 1"), plain[4:]):
        with pytest.raises(ValueError):
            list(warc.read_archive(pack(broken)))
