"""Range joins by aligned blocks, and suffixes by equality."""

import random

import pytest
from pyspark.sql import functions as F

from pathglass.operators import compare, symbols

PAGE = 1 << symbols.PAGE_BITS


def test_covers_part_a_range_once(spark):
    r = random.Random(1)
    ranges = [(0, 1), (5, PAGE), (PAGE - 1, PAGE + 1), (3 * PAGE, 3 * PAGE + 1), (7, 7 + (1 << 40)), (-5 * PAGE, 9 * PAGE + 3), (-(1 << 62), 1 << 62), (PAGE, 8 * PAGE), (5, 5)]
    ranges += [(a := r.randint(-(1 << 50), 1 << 50), a + r.randint(1, 1 << r.randint(1, 45))) for _ in range(60)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(ranges)], "id int, low long, high long").filter("high > low")
    for row in df.select("low", "high", symbols.cover(F.col("low"), F.col("high")).alias("c")).collect():
        parts = sorted((b.block << b.level, (b.block + 1) << b.level) for b in row.c)
        assert parts[0][0] == row.low // PAGE and parts[-1][1] == (row.high - 1) // PAGE + 1
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 2 * symbols.LEVELS and (row.high - row.low > PAGE or len(parts) <= 2)


def test_ranges_of_any_width_meet_by_equality(spark):
    r = random.Random(2)
    ranges = [(k % 2, a := r.randint(0, 1 << 30), a + r.randint(1, 1 << r.choice([4, 12, 22, 28])), k) for k in range(300)]
    ranges += [(0, 100, 100 + (1 << 40), 300), (1, -(1 << 40), 1 << 33, 301), (0, 9, 9, 302)]
    probes = [(k, k % 3, r.choice([r.randint(0, 1 << 30), r.choice(ranges)[1], r.choice(ranges)[2], -5, 1 << 39])) for k in range(800)]
    left = spark.createDataFrame(probes, "id int, pid int, at long")
    right = spark.createDataFrame(ranges, "pid int, low long, high long, n int")
    met = symbols.within(left, right, ("pid",), "at", "low", "high")
    want = sorted((i, n) for i, p, a in probes for q, lo, hi, n in ranges if p == q and lo <= a < hi)
    assert sorted((x.id, x.n) for x in met.collect()) == want
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in [x for x in plan.splitlines() if "Join" in x][0]
    assert symbols.within(left, right.limit(0), ("pid",), "at", "low", "high").count() == 0


@pytest.mark.parametrize("pairs", [[("b/c", "/y"), ("nothing", "x/y"), ("", "zzz"), ("a/b/c", "a/b/c/d")], []])
def test_explicit_pairs_meet_by_equality(spark, pairs):
    paths = ["a/b/c", "b/c", "c", "x/y", "a/x/y"]
    rows = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, place int")
    wanted = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "pair int, b string, c string")
    for side, at in (("b", 0), ("c", 1)):
        got = compare._explicit(rows, wanted, side)
        want = {k: min((n for n, p in enumerate(paths) if p.endswith(pair[at])), default=None) for k, pair in enumerate(pairs)}
        assert {x.pair: x.place for x in got.collect()} == {k: v for k, v in want.items() if v is not None}
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_an_address_are_looked_up_once(spark, monkeypatch):
    held, cut = {}, symbols.cut

    def spy(df, what):
        held[what] = cut(df, what)
        return held[what]

    monkeypatch.setattr(symbols, "cut", spy)
    probes = spark.range(3000).selectExpr("id", "'i' AS image_id", "id % 10 * 32 AS address", "'f1' AS symbol")
    functions = spark.range(5).selectExpr("'i' AS image_id", "id", "concat('f', id) AS name", "id * 64 AS start", "id * 64 + 32 AS end")
    got = symbols.symbolize(probes.drop("symbol"), functions)
    assert got.columns == ["id", "image_id", "address", "function", "symbol", "offset"]
    assert {(r.address, r.symbol, r.offset) for r in got.collect()} == {(k * 32, f"f{k // 2}" if k % 2 == 0 else None, 0 if k % 2 == 0 else None) for k in range(10)}
    assert got.count() == 3000 and held["asked"].count() == 10
    ranges = spark.range(100_000).selectExpr("'i' AS image_id", "id * 32 AS lo", "id * 32 + 4 AS hi", "array(named_struct('function', concat('f', id), 'line', id)) AS frames")
    framed = symbols.inline_frames(probes, ranges)
    assert {(r.address, r.inlined, r.frames[0].line) for r in framed.collect()} == {(k * 32, f"f{k}" if k != 1 else None, k) for k in range(10)}
    # An address is compared with the ranges of its own page alone.
    assert framed.count() == 3000 and held["asked"].count() == 10 and held["covers"].filter("__level = 0 and __block = 0").count() <= 256
