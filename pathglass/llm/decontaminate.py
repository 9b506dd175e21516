"""Benchmark decontamination by spaced seeds (operator 6).

A seed is the hash of the words at a mask's marked positions, so a substituted word
at an unmarked one leaves it unchanged. Training seeds are joined to those of the
benchmark items; around each hit the two word sequences are aligned and compared
position by position. The masks are lossless: whatever words of a window are
substituted, one of them hits as long as enough words agree. Everything is
DataFrame functions.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglass.llm.common import materialise

#: Marked positions count, others are ignored. Windows take the first set of which
#: a mask hits under every substitution they allow: at 75 % the first holds for 6, 7
#: and from 9 to 13 words, the others for 3, 5 and 8, for 4, for 2 and for 1.
MASK_SETS = (("11101", "100111"), ("111", "1101"), ("111", "1101", "1011"), ("11",), ("1",))
#: Aligned words looked at together (or the whole item, if it is shorter), and the
#: share of them that must agree.
WINDOW, SHARE_PERCENT = 13, 75
#: The benchmark's seeds are broadcast up to this many (about 50 bytes each) and
#: shuffled beyond; so are the places where texts are to be compared.
BROADCAST_SEEDS = 500_000
BROADCAST_PLACES = 200_000

WORD = r"[\p{L}\p{N}]+"


def word_array(text: Column) -> Column:
    """Lower-case runs of letters and digits; empty for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(text: str) -> Column:
    return F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def covers(masks: tuple[str, ...], n: int, lost: int) -> bool:
    """Whether some mask hits, wherever ``lost`` of ``n`` words are substituted."""
    places = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    return all(any(p.isdisjoint(gone) for p in places) for gone in combinations(range(n), lost))


@cache
def masks_for(n: int, share_percent: int = SHARE_PERCENT) -> tuple[str, ...]:
    """Masks of which one hits any window of ``n`` words that agrees to ``share_percent``."""
    agree = max(1, -(-n * share_percent // 100))
    if comb(n, n - agree) <= 5_000:
        for masks in MASK_SETS:
            if covers(masks, n, n - agree):
                return masks
    # Too many patterns to go through: the words that agree form a run at least so long.
    return ("1" * -(-agree // (n - agree + 1)),)


def _seed_array(h: Column, wanted: dict[str, Column | None]) -> Column:
    def of_mask(mask: str, condition: Column | None) -> Column:
        marked = [k for k, c in enumerate(mask) if c == "1"]

        def seed(i: Column) -> Column:
            return F.struct(F.xxhash64(F.lit(mask), *(F.get(h, i + k) for k in marked)).alias("seed"), i.alias("pos"))

        made = F.transform(F.sequence(F.lit(0), F.size(h) - len(mask)), seed)
        fits = F.size(h) >= len(mask)
        return F.when(fits if condition is None else fits & condition, made).otherwise(F.array().cast("array<struct<seed: bigint, pos: int>>"))

    return F.concat(*(of_mask(mask, condition) for mask, condition in wanted.items()))


def seeds(df: DataFrame, hashes: Column, wanted: dict[str, Column | None], *keep: str) -> DataFrame:
    """(keep..., seed, pos) for every start in the array of word hashes and mask, where its condition holds.

    Null seeds stand for rows without any; the outer form keeps the optimizer from
    computing the array a second time to filter by its size.
    """
    return df.select(*keep, F.explode_outer(_let(hashes, lambda h: _seed_array(h, wanted))).alias("s")).select(*keep, "s.seed", "s.pos")


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, h): items with equal words once, under the smallest id."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), _hashes(text_col).alias("h"))
    return rows.groupBy("h").agg(F.min("item_id").alias("item_id")).select("item_id", "h")


def _counted(df: DataFrame, limit: int) -> DataFrame:
    """``df``, broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def _overlaps(rows: DataFrame, items: DataFrame, window: int, share_percent: int) -> DataFrame:
    """(key, item_id, b) for rows (key, __text) and items (item_id, h): the best overlap of each pair.

    Texts stay where they are read unless very many of them hold a seed: what
    travels are the places to compare, one row for each key.
    """
    width = F.least(F.size("h"), F.lit(window))
    widths = sorted(r[0] for r in items.select(width).distinct().collect() if r[0] > 0)
    by_mask = {m: [w for w in widths if m in masks_for(w, share_percent)] for m in sorted({m for w in widths for m in masks_for(w, share_percent)} or {"1"})}
    own = seeds(items.withColumn("len", F.size("h")), F.col("h"), {m: width.isin(ws) for m, ws in by_mask.items()}, "item_id", "len")
    own = _counted(own.filter("seed is not null").withColumnRenamed("pos", "item_pos"), BROADCAST_SEEDS)
    hits = seeds(rows, _hashes("__text"), dict.fromkeys(by_mask), "key").join(own, "seed")
    # A diagonal is one alignment, however many seeds hit it. The words of a text are
    # found once for all of its diagonals, which take their own stretch of them.
    places = hits.groupBy("key").agg(F.collect_set(F.struct("item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "len")).alias("places"))
    places = _counted(materialise(places, "seed-hits"), BROADCAST_PLACES)

    def stretches(h: Column) -> Column:
        def stretch(p: Column) -> Column:
            start = F.greatest(p["diagonal"], F.lit(0))
            return F.struct(p["item_id"].alias("item_id"), p["diagonal"].alias("diagonal"), F.slice(h, start + 1, p["diagonal"] + p["len"] - start).alias("part"))

        return F.transform("places", stretch)

    aligned = rows.join(places, "key").select("key", F.explode(_let(_hashes("__text"), stretches)).alias("p")).select("key", "p.*")
    aligned = aligned.join(items.withColumnRenamed("h", "ih"), "item_id")
    # A part starts at the text's first word where the item begins before it.
    agree = F.transform("ih", lambda x, i: F.coalesce(F.get("part", i + F.least("diagonal", F.lit(0))) == x, F.lit(False)).cast("int"))
    n = F.least(F.size("ih"), F.lit(window))

    def best_window(agree: Column) -> Column:
        # Most agreeing words win, then the first place.
        starts = F.sequence(F.lit(0), F.size(agree) - n)
        return F.array_max(F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(agree, i + 1, n), F.lit(0), lambda a, x: a + x).alias("matched"), (-i).alias("at"))))

    best = _let(agree, best_window)
    aligned = aligned.select("key", "item_id", "diagonal", n.alias("n"), best.alias("best"))
    found = aligned.filter(100 * F.col("best.matched") >= share_percent * F.col("n"))
    found = found.select("key", "item_id", F.struct(F.col("best.matched").alias("matched"), (F.col("best.at") - F.col("diagonal")).alias("neg_start"), F.col("best.at").alias("at"), "n").alias("b"))
    return found.groupBy("key", "item_id").agg(F.max("b").alias("b"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share_percent: int = SHARE_PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_id, doc_start, item_start, matched, compared): a row for each document and item that overlap.

    An overlap is a stretch of ``window`` aligned words (the whole item, if shorter)
    of which ``share_percent`` agree, and at least one; given is the one with
    most agreeing words, then the first in the document. Items are sought by the
    masks of their own window, so that none is too short. Rows with a null id are not reported, items with a null id neither; rows that repeat an
    id are reported under it together. Other columns are not read; an empty table
    on either side gives no rows.
    """
    items = benchmark_items(benchmark, item_col, item_text_col).filter("item_id is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("__text")).filter("key is not null")
    return _overlaps(rows, items, window, share_percent).select(
        F.col("key").alias(id_col),
        "item_id",
        (-F.col("b.neg_start")).cast("long").alias("doc_start"),
        (-F.col("b.at")).cast("long").alias("item_start"),
        F.col("b.matched").cast("long").alias("matched"),
        F.col("b.n").cast("long").alias("compared"),
    )


def _text_key(text: str) -> Column:
    return F.struct(F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that overlap with a benchmark item.

    Rows are judged by their texts and items by their words, with or without ids.
    Rows stay where they are read, but where very many texts overlap.
    """
    words = benchmark.select(_hashes(item_text_col).alias("h")).distinct()
    items = words.select(F.xxhash64("h").alias("item_id"), "h")
    rows = docs.select(_text_key(text_col).alias("key"), F.col(text_col).alias("__text"))
    bad = _overlaps(rows, items, WINDOW, SHARE_PERCENT).select(F.col("key.one").alias("__one"), F.col("key.two").alias("__two")).distinct()
    bad = _counted(materialise(bad, "contaminated"), BROADCAST_PLACES)
    key = _text_key(text_col)
    return docs.join(bad, (key["one"] == bad["__one"]) & (key["two"] == bad["__two"]), "left_anti")


def contamination_sql(window: int = WINDOW, share_percent: int = SHARE_PERCENT) -> str:
    """The result in DuckDB's SQL: every diagonal with enough equal words, without masks or hashes."""
    words = f"regexp_extract_all(lower(coalesce(text, '')), '{WORD}')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, {words} AS w FROM benchmark) GROUP BY w),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
bw AS (SELECT item_id, least(len(w), {window}) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM b),
g AS (SELECT doc_id, item_id, dw.pos - bw.pos AS diagonal FROM dw JOIN bw USING (word) GROUP BY ALL HAVING 100 * count(*) >= {share_percent} * any_value(n)),
a AS (SELECT g.*, d.w AS dw, b.w AS bw, least(len(b.w), {window}) AS n FROM g JOIN d USING (doc_id) JOIN b USING (item_id)),
p AS (SELECT doc_id, item_id, diagonal, n, dw, bw, unnest(range(0, len(bw) - n + 1)) AS st FROM a),
m AS (SELECT doc_id, item_id, diagonal, n, st,
  len(list_filter(range(st, st + n), lambda i: i + diagonal >= 0 AND i + diagonal < len(dw) AND dw[i + diagonal + 1] = bw[i + 1])) AS matched FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, st + diagonal, st) AS k FROM m WHERE 100 * matched >= {share_percent} * n)
SELECT doc_id, item_id, CAST(st + diagonal AS BIGINT) AS doc_start, CAST(st AS BIGINT) AS item_start, CAST(matched AS BIGINT) AS matched, CAST(n AS BIGINT) AS compared FROM r WHERE k = 1"""
