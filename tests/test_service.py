"""The store and whole queries over it; the registered queries against DuckDB."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__
from pathglass.errors import TraceError
from pathglass.plans import oracle, star_queries
from pathglass.plans.query import run_query
from pathglass.plans.request import parse_query
from pathglass.plans.store import Store, archive_images, harvest, read_document, read_jsonl, sessions_page, write_jsonl
from pathglass.schemas import EVENTS, FUNCTIONS, GAPS, INLINE_ROWS, LOCATIONS, MAPPINGS, SPANS, THREADS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    span = lambda i, parent, start, end, done, function: (i, "t_1", function, parent, start, end, done, None, None, None)
    tables = {
        "spans": spark.createDataFrame([span(1, None, 0, 100, "complete", 1), span(2, 1, 10, 50, "complete", 2), span(3, 1, 60, None, "open_end", 2)], SPANS),
        "functions": spark.createDataFrame([(1, "_main", "main", "i", 0, 16), (2, "worker", None, "i", 16, 32)], FUNCTIONS),
        "threads": spark.createDataFrame([("t_1", 7, 1, 0, 100, None, 9, 9, 3, 0, 100, 1, [(0, 100)])], THREADS),
        "gaps": spark.createDataFrame([("t_1", "unknown", 5, 6, True, "x")], GAPS),
        "inline_rows": spark.createDataFrame([("t_1", 1, ["inner", "outer"], 5, 1, 10)], INLINE_ROWS),
        "events": spark.createDataFrame([(3, "t_1", 0, 5, 0x1004, 0x1100, "call", *([False] * 6), None, None), (4, "t_1", 1, 5, 0x1004, 0x1100, "call", *([False] * 6), 1, 3), (5, "t_1", 2, 6, 0x9999, 0x1100, "call", *([False] * 6), None, 3)], EVENTS),
        "locations": spark.createDataFrame([(1, "i", 4, 0x1004, 1, "a.c", 10, None), (3, "i", 8, 0x1100, 2, "b.c", 20, None)], LOCATIONS),
        "mappings": spark.createDataFrame([(0, 7, 0x1000, 0x2000, 0x10, "r-xp", "/bin/a", "b1", None, None)], MAPPINGS),
    }
    s.publish("a1", tables, {"detail": "calls", "ir_version": 1, "covered_start_ns": 0, "covered_end_ns": 100, "cache_key": "k", "quality": {"gap_count": 1}})
    s.publish("a0", {"spans": tables["spans"].limit(0)}, {"detail": "calls", "ir_version": 0})
    return s


def ask(store, **body):
    return run_query(store, parse_query(body))


def test_kinds(store):
    page = ask(store, kind="timeline", limit=2)
    assert [r["id"] for r in page["data"]] == [1, 2] and page["next_cursor"] == "2" and page["analysis"] == "a1"
    assert [r["id"] for r in ask(store, kind="timeline", limit=2, cursor="2")["data"]] == [3]
    page = ask(store, kind="hotpaths", group="path", sort="calls")
    assert [r["path"] for r in page["data"]] == ["main/worker", "main"] and page["totals"]["complete_calls"] == 2
    assert ask(store, kind="hotpaths", group="inline")["data"][0]["path"] == "main > outer > inner"
    assert ask(store, kind="at_instant", at_ns=70)["data"][0]["stack"] == ["main", "worker"]
    assert ask(store, kind="summary")["data"][0]["spans_count"] == 3
    assert ask(store, kind="quality")["data"] == {"gap_count": 1} and {a["id"] for a in ask(store, kind="summary")["data"][0]["analyses"]} == {"a0", "a1"}
    assert ask(store, kind="source", address=0x1020)["data"][0]["file_offset"] == 0x30
    assert ask(store, kind="source", location_id=3)["data"][0]["file"] == "b.c"
    assert ask(store, kind="source", evidence="a1:e4-e5")["data"][0]["id"] == 1
    # The first event of a range with a location; the end of a call without a beginning; a span's function.
    for evidence, location in (("a1:e3-e5", 1), ("a1:e5", 3), ("a1:sp2", 3), ("a1:f1", 1), ("a1:l3", 3)):
        assert ask(store, kind="source", evidence=evidence)["data"][0]["id"] == location
    for evidence in ("a1:e3", "a1:g1", "a1:sp9"):
        with pytest.raises(TraceError) as e:
            ask(store, kind="source", evidence=evidence)
        assert e.value.code == "NOT_FOUND"
    snapshot = {"images": [{"path": "/a"}, {"path": "/b"}], "missing_images": ["/b (deleted)"]}
    assert [r["missing"] for r in run_query(store, parse_query({"kind": "images"}), snapshot=snapshot)["data"]] == [False, True]
    report = store.spark.createDataFrame([(k, f"p{k}") for k in range(3)], "ord long, path string")
    assert run_query(store, parse_query({"kind": "comparison", "limit": 2}), report=report)["next_cursor"] == "2"
    hints = ask(store, kind="timeline", contains="nothing", selection={"thread": "t_9"})["hints"]
    assert len(hints) == 2 and "t_9" in hints[0]


@pytest.mark.parametrize("body,code", [({"kind": "branches"}, "DETAIL_NOT_READY"), ({"kind": "timeline", "selection": {"end_ns": 101}}, "INVALID_ARGUMENT"), ({"kind": "comparison"}, "INVALID_ARGUMENT"), ({"kind": "source", "location_id": 77}, "NOT_FOUND"), ({"kind": "source", "evidence": "a:x"}, "INVALID_ARGUMENT")])
def test_refusals(store, body, code):
    with pytest.raises(TraceError) as e:
        ask(store, **body)
    assert e.value.code == code


def test_store(store, spark, tmp_path):
    assert [m["id"] for m in store.catalog()] == ["a0", "a1"] or {m["id"] for m in store.catalog()} == {"a0", "a1"}
    assert store.default_analysis()["id"] == "a1" and store.find_cached("k")["id"] == "a1" and store.find_cached("no") is None
    assert store.read("a0", "gaps").count() == 0
    for bad in ("a1", "x/y", ""):
        with pytest.raises(TraceError):
            store.publish(bad, {}, {})
    with pytest.raises(TraceError):
        store.manifest("nothing")
    other = Store(spark, f"file://{tmp_path}/s")
    assert other.catalog() == []
    other.publish("old", {"t": spark.range(2000)}, {})
    other.publish("new", {"t": spark.range(10)}, {})
    spark.range(3).write.parquet(f"file://{tmp_path}/s/half/t")
    assert {r.analysis for r in other.sizes().collect()} == {"old", "new", "half"}
    spark.range(3).write.parquet(f"file://{tmp_path}/s/{Store.STAGING}x/t")
    assert other.sweep() == [] and other.sweep(older_than_s=-5) == [f"{Store.STAGING}x", "half"]
    with pytest.raises(TraceError):
        other.import_analysis(f"file://{tmp_path}/s/old", ["../new/t"], {"id": "y"})
    with pytest.raises(TraceError):
        other.import_analysis(f"file://{tmp_path}/s/old", ["t"], {"id": "y"}, budget_bytes=1)
    assert [other.import_analysis(f"file://{tmp_path}/s/old", ["t"], {"id": "copy"}) for _ in range(2)] == [True, False]
    assert other.read("copy", "t").count() == 2000 and other.prune(0, keep=("new", "old")) == ["copy"]
    assert other.prune(1, keep=("new",)) == ["old"] and [m["id"] for m in other.catalog()] == ["new"]
    assert read_jsonl(spark, f"{tmp_path}/none.jsonl", "spans").count() == 0
    (tmp_path / "s.jsonl").write_text('{"id": 1, "thread": "t_1"}\n\n{"id": 2}\n')
    assert read_jsonl(spark, f"{tmp_path}/s.jsonl", "spans").count() == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        read_jsonl(spark, f"{tmp_path}/bad.jsonl", "spans").collect()


def test_documents_sessions_and_images(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{oops")
    assert read_document(spark, f"file://{tmp_path}/m.json") == {"a": 1}
    for name, code in (("none.json", "NOT_FOUND"), ("bad.json", "DECODE_FAILED")):
        with pytest.raises(TraceError) as e:
            read_document(spark, f"file://{tmp_path}/{name}")
        assert e.value.code == code
    sessions = spark.range(5).selectExpr("concat('s', id) as id")
    page = sessions_page(sessions, "2", 2)
    assert [r["id"] for r in page["data"]] == ["s2", "s3"] and page["next_cursor"] == "4"
    assert sessions_page(sessions, "what", 900) == {"data": [{"id": f"s{k}"} for k in range(5)], "next_cursor": None}
    write_jsonl(spark.createDataFrame([(1, None), (2, "x")], "id long, thread string"), f"file://{tmp_path}/rows")
    assert sorted("".join(f.read_text() for f in (tmp_path / "rows").glob("*.json")).split()) == ['{"id":1}', '{"id":2,"thread":"x"}']
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a").write_bytes(b"elf")
    assert archive_images(spark, f"file://{tmp_path}/img").first().sha256 == hashlib.sha256(b"elf").hexdigest()
    maps = spark.createDataFrame([("/a", 5), ("/b", 1), ("[vdso]", 0), ("/c", 7), ("/d", 9), ("/b", 8)], "path string, seq long")
    sizes = spark.createDataFrame([("/a", 50), ("/b", 60), ("/c", 30), ("/d", 5)], "path string, bytes long")
    got = harvest(maps, sizes, spark.createDataFrame([("/d",)], "path string"), 100)
    assert [tuple(r) for r in got.collect()] == [("/b", 60), ("/c", 30)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    got = star_queries.QUERIES[name](spark, SF)
    want = duck.sql(oracle.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(map(tuple, got.collect()), got.columns) == comparable(want.fetchall(), want.columns)


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(star_queries.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
