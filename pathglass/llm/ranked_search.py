"""Ranked lexical search, document at a time (operator 11).

Documents are dealt to shards of bounded text. A shard's postings are lists in
ascending doc_id order, kept as gaps and frequencies of the fewest bytes that hold
them. A search merges the lists of an item's terms by a heap, one document after the
other, into a bounded heap of the best (score, then smaller doc_id); lists that could
not lift a document into it by themselves are not merged but probed for the documents
that the others bring up. The best of all shards are merged by rank. Items go in blocks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathglass.llm.common import HOT_KEYS, materialise, task_tables, text_stream

#: A shard is closed when its texts hold this many bytes.
SHARD_BYTES = 16 << 20
#: Items searched together in a shard.
ITEM_BLOCK = 256
#: Fixed values of the scoring rule: the share of length in it, in percent, and its scale.
LENGTH_PERCENT, SCALE = 90, 1_000_000_000

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_CLEAN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_CLEAN).split()


def _least(x: np.ndarray) -> np.ndarray:
    """``x`` in the fewest bytes an element."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def pack_postings(at: np.ndarray, tf: np.ndarray) -> bytes:
    """Ascending document numbers of the shard and frequencies: two widths, gaps, frequencies."""
    gaps, tf = _least(np.diff(at, prepend=0)), _least(tf)
    return bytes((gaps.itemsize, tf.itemsize)) + gaps.tobytes() + tf.tobytes()


def unpack_postings(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    wide = data[0]
    gaps, tf = np.frombuffer(data, f"<u{wide}", n, 2), np.frombuffer(data, f"<u{data[1]}", n, 2 + n * wide)
    return np.cumsum(gaps, dtype=np.int64), tf.astype(np.int64)


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


#: ``term`` is empty in the row that holds a shard's documents: ids, then numbers of terms, 64 bit each.
INDEX = "shard long, term binary, df long, total long, postings binary"


def shard_rows(keys: list, tokens: list[np.ndarray], numbers: dict[bytes, int]):
    """(term, df, total, postings) of a shard: documents first, then its terms.

    Documents without id are the last ones of all postings, and not in the first row's list.
    """
    order = sorted(range(len(keys)), key=lambda k: (keys[k] is None, keys[k]))
    named = sum(k is not None for k in keys)
    sizes = np.array([len(tokens[k]) for k in order], np.int64)
    yield b"", int((sizes > 0).sum()), int(sizes.sum()), np.array([keys[k] for k in order[:named]], np.int64).tobytes() + sizes[:named].tobytes()
    spread = np.concatenate([tokens[k] for k in order]).astype(np.int64) * len(order) + np.repeat(np.arange(len(order)), sizes)
    found, tf = np.unique(spread, return_counts=True)
    term, at = np.divmod(found, max(1, len(order)))
    starts = np.searchsorted(term, np.arange(len(numbers) + 1))
    for name, number in numbers.items():
        a, b = starts[number], starts[number + 1]
        yield name, int(b - a), int(tf[a:b].sum()), pack_postings(at[a:b], tf[a:b])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """INDEX of all documents, written to the shared folder."""

    def run(batches):
        names, part, number = ["shard", "term", "df", "total", "postings"], TaskContext.get().partitionId(), 0
        with task_tables("postings"):
            keys, tokens, numbers, held = [], [], _Numbers(), 0

            def flush():
                shard = (part << 33) + number
                rows, size = [], 0
                for r in shard_rows(keys, tokens, numbers):
                    rows.append((shard, *r))
                    size += len(r[3]) + 64
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            for b in batches:
                for key, text in zip(b.column("__id").to_pylist(), text_stream(b, "__text"), strict=True):
                    words = terms(text)
                    keys.append(key)
                    tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    held += len(text) + 8
                    if held >= shard_bytes:
                        yield from flush()
                        number += 1
                        keys, tokens, numbers, held = [], [], _Numbers(), 0
            if held:
                yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return materialise(rows.mapInArrow(run, INDEX), "postings")


def length_part(n, documents: int, total: int):
    """m of documents with ``n`` terms, an int64 array; whole numbers throughout."""
    if not total:
        return np.zeros_like(n)
    if LENGTH_PERCENT * int(n.max(initial=0)) * documents >= 1 << 63:
        n = n.astype(object)
    return (100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // total).astype(np.int64)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class PostingList:
    """A term's documents in a shard and what each one's score gains by it."""

    def __init__(self, at: np.ndarray, gain: np.ndarray, k: int):
        self.top = int(gain.max(initial=0))
        #: So much the k-th best document has at least, if the list is long enough.
        self.floor = int(np.partition(gain, len(gain) - k)[len(gain) - k]) if len(gain) >= k else 0
        self.at, self.gain = at.tolist(), gain.tolist()


def best_documents(lists: list[PostingList], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best documents above 0, best first and equal scores by document.

    A heap holds the next document of each merged list. Documents come in ascending
    order, so one that only equals the worst of k kept ones is not better.
    """
    lists = sorted((x for x in lists if x.top > 0), key=lambda x: (x.top, -len(x.at)))
    reach, total = [], 0
    for x in lists:
        total += x.top
        reach.append(total)
    floor = max((x.floor for x in lists), default=0)  # scores below it are not wanted, equal ones are
    kept: list[tuple[int, int]] = []  # (score, -document), the worst first
    first = sum(r < floor for r in reach)  # lists below it cannot reach the floor together
    place = [0] * len(lists)
    heap = [(x.at[0], i) for i, x in enumerate(lists) if i >= first]
    heapq.heapify(heap)
    while heap:
        d, i = heap[0]
        score = 0
        while heap and heap[0][0] == d:
            i = heap[0][1]
            x, p = lists[i], place[i]
            score += x.gain[p]
            p += 1
            place[i] = p
            if p < len(x.at):
                heapq.heapreplace(heap, (x.at[p], i))
            else:
                heapq.heappop(heap)
        for i in range(first - 1, -1, -1):
            if score + reach[i] < floor or (len(kept) == k and score + reach[i] <= kept[0][0]):
                score = 0
                break
            x = lists[i]
            p = place[i] = bisect_left(x.at, d, place[i])
            if p < len(x.at) and x.at[p] == d:
                score += x.gain[p]
        if score < floor or not score or (len(kept) == k and score <= kept[0][0]):
            continue
        if len(kept) < k:
            heapq.heappush(kept, (score, -d))
        else:
            heapq.heapreplace(kept, (score, -d))
        if len(kept) == k:
            moved = first
            while moved < len(lists) and reach[moved] <= kept[0][0]:
                moved += 1
            if moved > first:
                first = moved
                heap = [e for e in heap if e[1] >= first]
                heapq.heapify(heap)
    return sorted(((s, -d) for s, d in kept), key=lambda e: (-e[0], e[1]))


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", block: int = ITEM_BLOCK) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of an index for each row of ``items``.

    Items are rows: those that repeat an id have ranks of their own, null ids stay, and
    items without a known term have no rows. Documents of one id are ranked each.
    """
    spark = index.sparkSession
    corpus = index.filter("term = X''").agg(F.sum("df"), F.sum("total")).first()  # one row
    documents, total = corpus[0] or 0, corpus[1] or 0

    def item_terms(batches):
        for b in batches:
            at, found = [], []
            for i, text in enumerate(text_stream(b, "__text")):
                mine = sorted(set(terms(text)))
                at += [i] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], ["item", "term"])

    number = F.monotonically_increasing_id()
    listed = materialise(items.select(number.alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).alias("__text")), "items")
    asked = listed.select("item", "__text").mapInArrow(item_terms, "item long, term binary")
    blocks = max(1, -(-listed.count() // block))
    asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), "item-terms")
    # A row for each term and block: at most ``block`` items, or what hashing deals to it.
    wanted = materialise(asked.groupBy("term", "block").agg(F.collect_list("item").alias("items")), "wanted")
    names = materialise(wanted.select("term").distinct(), "terms")
    few = F.broadcast if names.count() <= HOT_KEYS else (lambda t: t)
    known = materialise(index.join(few(names), "term", "left_semi"), "wanted-postings")
    df = known.groupBy("term").agg(F.sum("df").alias("held"))
    wanted = materialise(wanted.join(df, "term"), "weighed")
    spread = known.join(few(wanted), "term").select("shard", "block", "term", "df", "held", "items", "postings")
    everywhere = index.filter("term = X''").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "df", F.lit(0).cast("long").alias("held"), F.lit(None).cast("array<long>").alias("items"), "postings")
    open_ = spread.select("shard", "block").distinct()
    spread = spread.unionByName(everywhere.join(open_, ["shard", "block"], "left_semi") if blocks > 1 else everywhere)

    def run(table: pa.Table) -> pa.Table:
        rows = dict(zip(table.column("term").to_pylist(), zip(*(table.column(c).to_pylist() for c in ("df", "held", "items", "postings")), strict=True), strict=True))
        whole = np.frombuffer(rows.pop(b"")[3], np.int64).reshape(2, -1)
        ids, m = whole[0], length_part(whole[1], documents, total)
        lists: dict[int, list[PostingList]] = {}
        for n, held, those, postings in rows.values():
            at, tf = unpack_postings(postings, n)
            named = int(np.searchsorted(at, len(ids)))
            at, tf = at[:named], tf[:named]
            found = PostingList(at, weight(documents, held) * (SCALE * tf // (1000 * tf + 8 * m[at])), k)
            for item in those:
                lists.setdefault(item, []).append(found)
        out = [(item, int(ids[d]), score) for item, mine in lists.items() for score, d in best_documents(mine, k)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], names=["item", "doc_id", "score"])

    found = spread.groupBy("shard", "block").applyInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(listed.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents with a score above 0 for each row of ``items``.

    Null, empty and term-free texts are found by none and ask for nothing. Documents
    without id count in the corpus figures but are not listed; rows that repeat an id
    are documents of their own. Empty tables give no rows; other columns are not read.
    """
    index = build_index(docs, id_col, text_col, shard_bytes)
    return search(index, items, k, item_col, text_col, id_col)


def search_sql(k: int = 10) -> str:
    """The rule over `documents` and `benchmark` without an index."""
    upper, lower = ("".join(map(chr, range(at, at + 26))) for at in (65, 97))
    term_list = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest({term_list}) AS term FROM documents),
n AS (SELECT r, doc_id, count(*) AS n FROM d GROUP BY r, doc_id),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
t AS (SELECT r, term, count(*) AS tf FROM d GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT item_id, row_number() OVER () AS i, unnest({term_list}) AS term FROM benchmark)),
s AS (SELECT i, item_id, doc_id, sum(CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // l))))) AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN n USING (r), c WHERE doc_id IS NOT NULL GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= {k}"""
