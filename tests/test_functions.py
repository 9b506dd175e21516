"""Scalar functions and request checks."""

import pytest
from pyspark.sql import functions as F

from pathglass.errors import TraceError
from pathglass.functions import scalars
from pathglass.functions.flags import BOUNDARIES, boundary, flag_set, flow_kind
from pathglass.plans import page, render, request


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("text,ns", [("1.000000001", 1000000001), ("0.5", 500000000), ("0.000000000", None), ("x", None), ("513961.572104246", 513961572104246), ("1.1234567891", 1123456789), ("99999999999999.0", None)])
def test_trace_times(spark, text, ns):
    assert one(spark, scalars.trace_time_ns(F.col("t")), t=text) == ns


@pytest.mark.parametrize("text,value", [("0x1f", 31), ("0X1F", 31), ("1f", 31), ("0x", None), ("zz", None), ("ffffffffffffffff", None), ("7fffffffffffffff", (1 << 63) - 1)])
def test_addresses(spark, text, value):
    assert one(spark, scalars.parse_address(F.col("t")), t=text) == value
    if value is not None:
        assert one(spark, scalars.address_hex(F.col("v")), v=value) == f"0x{value:x}"


def test_names(spark):
    stem = lambda t: one(spark, scalars.linkage_stem(F.col("t")), t=t)
    assert [stem(x) for x in ("foo::bar::hdeadbeef", "foo::hdead", "foo", "a::h12345678::h87654321")] == ["foo::bar", "foo::hdead", "foo", "a::h12345678"]
    assert one(spark, scalars.shorten_path(F.col("p"), 2), p="a/b/c") == "a/b/..."
    assert one(spark, scalars.shorten_path(F.col("p"), 3), p="a/b/c") == "a/b/c"
    parts = one(spark, scalars.split_namespaced_id(F.col("t")), t="an:x:sp12")
    assert tuple(parts) == ("an:x", "sp", 12)
    assert one(spark, scalars.split_namespaced_id(F.col("t")), t="an:q1") is None
    assert one(spark, scalars.thread_name(F.col("t"), F.col("g")), t=7, g=1) == "t_7_g1"
    assert one(spark, scalars.relative_delta(F.col("d"), F.col("b")), d=5, b=10) == 0.5
    assert one(spark, scalars.relative_delta(F.col("d"), F.col("b")), d=5, b=0) is None
    assert one(spark, scalars.tsc_to_ns(F.col("t"), 5, 10, 2048), t=1025) == 5 + 2050
    missing = F.array(F.lit("/lib/a (deleted)"))
    assert one(spark, scalars.is_missing_image(F.col("p"), missing), p="/lib/a") is True


@pytest.mark.parametrize("text,kind,bits", [("call tr strt", "trace_begin", {"trace_begin"}), ("hw int", "async_boundary", {"async_event", "interrupt"}), ("int", "async_boundary", {"interrupt"}), ("tr end syscall", "trace_end", {"trace_end", "syscall"}), ("jcc", "conditional", set()), ("jmp", "jump", set()), (None, "jump", set()), ("bc", "call", set()), ("tx abrt", "async_boundary", {"transaction"}), ("iret", "async_boundary", {"interrupt"})])
def test_flags(spark, text, kind, bits):
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", flag_set(F.col("t")))
    got = df.select(flow_kind(F.col("s")).alias("kind"), *(c.alias(n) for n, c in boundary(F.col("s")).items())).first()
    assert got.kind == kind and {b for b in BOUNDARIES if got[b]} == bits


def test_unknown_flag_words(spark):
    flags = lambda t: set(one(spark, flag_set(F.col("t")), t=t))
    assert flags("call nonsense!") == {"call", "unknown"} and flags("bcx") == {"call", "unknown"} and flags("hw") == set()


def test_requests_are_checked():
    for body in ({"kind": "nothing"}, {"kind": "timeline", "x": 1}, {"kind": "timeline", "selection": {"start_ns": 5, "end_ns": 5}}, {"kind": "timeline", "limit": 0}, {"kind": "timeline", "limit": 201}, {"kind": "timeline", "cursor": "x"}, {"kind": "at_instant"}, {"kind": "source"}, {"kind": "hotpaths", "group": "inline", "selection": {"start_ns": 1}}, {"kind": "timeline", "selection": {"end_ns": 1 << 53}}, {}):
        with pytest.raises(TraceError) as e:
            request.parse_query(body)
        assert e.value.code == "INVALID_ARGUMENT" and e.value.as_dict()["reason"]
    assert request.parse_query({"kind": "timeline", "cursor": "40"}).page() == (40, 50)
    assert request.parse_query({"kind": "hotpaths", "group": "inline"}).shown_depth() == 3
    with pytest.raises(TraceError):
        request.Selection(start_ns=1, end_ns=9).check_covered(2, 20)
    assert request.parse_cpu_list("4-7,9, 4") == [4, 5, 6, 7, 9]
    assert request.parse_address_filter("start:f@g@/bin/x") == {"kind": "start", "symbol": "f@g", "image": "/bin/x"}
    for bad in ("7-4", "a", ""):
        with pytest.raises(TraceError):
            request.parse_cpu_list(bad)


def test_pages_and_budget():
    rows = list(range(5))
    assert [page.page_of(rows, o, 2) for o in (0, 2, 4)] == [([0, 1], "2"), ([2, 3], "4"), ([4], None)]
    got = page.fit({"data": [{"threads": [f"t_{k}" for k in range(400)]}]}, 2000)
    assert got["data"][0]["truncated_fields"] == ["threads"] and len(got["data"][0]["threads"]) < 400
    assert page._size(got) <= 2000
    many = page.fit({"data": [{"name": "x" * 100} for _ in range(50)], "next_cursor": None}, 2000, offset=10)
    assert many["truncated"] and many["next_cursor"] == str(10 + len(many["data"])) and page._size(many) <= 2000
    assert page.fit({"data": [{"n": 10**400}]}, 100)["data"] == [{"omitted": "the row exceeds the page's budget"}]


def test_renderers():
    rows = [{"path": 'a"b', "observed_entries": 3, "self_sum_ns": 500_000, "inclusive_sum_ns": 2_000_000, "complete_calls": 2, "p99": None}]
    shown = {"data": rows, "next_cursor": "1", "totals": {"self_sum_ns": 1_000_000}}
    assert render.as_lines(shown).splitlines() == ['observed_entries=3 self_sum_ns=500000 inclusive_sum_ns=2000000 complete_calls=2 path=a"b', "next_cursor=1"]
    assert render.as_csv(shown).splitlines()[1].endswith(',1,"a""b"')
    assert render.as_table(shown).splitlines()[1].split() == ["0.500", "50.0", "2.000", "2", 'a"b']
    assert "t_1 2.000 ms" in render.coverage_line([{"thread": "t_1", "covered_ns": 2_000_000, "segment_count": 2}])
