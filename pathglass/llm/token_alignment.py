"""Alignment of two tokenizers' tokens over the same bytes (operator 12).

Every token is an event at the byte offset where it ends. The end events of both
tokenizers are unioned, dealt by document and sorted by offset, and a machine sweeps
over each document's events: where both tokenizers end, a group closes. Its state is
the open group, so a document of any length passes through in bounded blocks. Events
travel in blocks of up to EVENTS tokens of one side, which hold the ids alone; lengths
follow from the vocabulary. Out come groups (which tokens of A cover the same bytes as
which of B) and links (all pairs of tokens within a group).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.llm.bpe_fst import PieceTable, byte_letters, split_as_library
from pathglass.llm.common import Scratch, join_spread, release_with, task_tables, text_stream

#: Tokens in an event block.
EVENTS = 4_096
#: Groups with more pairs than this count equal tokens before they are paired.
PAIRED = 1 << 16
#: Pair counts are broadcast up to this many (16 bytes each); beyond, hot ones are and the others meet by shuffle.
BROADCAST_PAIRS = 1_000_000

_UNIT = re.compile("^[^ ]+| +[^ ]*")


class Side(NamedTuple):
    """A tokenizer: ``encode`` packs the ids of space + text, MISSPELT for a part that they do not
    spell back; ``tokens`` are the bytes of each id."""

    encode: object
    tokens: list[bytes]


#: Stands for a part of a text whose tokens have other bytes.
MISSPELT = np.uint32(0xFFFFFFFF)


def _packed(ids, part: bytes, tokens: list[bytes]) -> bytes:
    fits = b"".join(map(tokens.__getitem__, ids)) == part
    return np.array(ids if fits else [MISSPELT], np.uint32).tobytes()


def _byte_level(path: str) -> Side:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    letters = byte_letters()
    shown = "".join(sorted(letters, key=letters.get))
    names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
    tokens = [bytes(letters[c] for c in name) if all(c in letters for c in name) else b"" for name in names]

    def make(piece: str) -> bytes:
        raw = piece.encode()
        return _packed([x.id for x in t.model.tokenize(raw.decode("latin-1").translate(shown))], raw, tokens)

    pieces = PieceTable(make, 200_000)
    return Side(lambda text: b"".join(map(pieces.__getitem__, split_as_library(" " + text))), tokens)


def _pieces(path: str) -> Side:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    # No piece has a space behind another character, so words with the spaces before
    # them never merge with each other. The library adds the first space itself.
    apart = not any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in tokens)

    def make(part: str) -> bytes:
        # A lone space at the end of a text; before an empty text the library adds none.
        ids = sp.encode(part[1:], num_threads=1) if part != " " else [sp.piece_to_id("▁")]
        return _packed(ids, part.encode(), tokens)

    units = PieceTable(make, 200_000)

    def encode(text: str) -> bytes:
        if not apart or "▁" in text:
            return make(" " + text)
        return b"".join(map(units.__getitem__, _UNIT.findall(" " + text)))

    return Side(encode, tokens)


@lru_cache(maxsize=2)
def side(path: str) -> Side:
    """A .json file of the tokenizers library (byte-level BPE) or a .model file of sentencepiece."""
    return _byte_level(path) if path.endswith(".json") else _pieces(path)


@lru_cache(maxsize=4)
def lengths(path: str) -> np.ndarray:
    return np.fromiter(map(len, side(path).tokens), np.int64)


def id_type(path: str) -> np.dtype:
    """Of the ids in an event block: the fewest bytes that hold them."""
    return np.dtype("<u2" if len(lengths(path)) <= 1 << 16 else "<u4")


def checked(text: str, s: Side) -> np.ndarray | None:
    """The ids of space + text, or None if their bytes are others."""
    ids = np.frombuffer(s.encode(text), np.uint32)
    return None if (ids == MISSPELT).any() else ids


EVENT = "row long, id long, side int, first long, known boolean, ids binary"


def _side_events(docs: DataFrame, path: str, number: int, events: int) -> DataFrame:
    """(row, id, side, first, known, ids): a head at -1 for each document, then its blocks, ``first`` being
    the end of a block's first token."""

    def run(batches):
        with task_tables("alignment"):
            release_with("alignment", side.cache_clear)
            s, width, small = side(path), lengths(path), id_type(path)

            def batch(rows):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["row", "id", "side", "first", "known", "ids"])

            for b in batches:
                out, held = [], 0
                for row, key, text in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), text_stream(b, "__text"), strict=True):
                    ids = checked(text, s) if text else None
                    out.append((row, key, number, -1, ids is not None, None))
                    if ids is not None:
                        ends, ids = np.cumsum(width[ids]), ids.astype(small)
                        for k in range(0, len(ids), events):
                            out.append((row, key, number, int(ends[k]), True, ids[k : k + events].tobytes()))
                            held += min(events, len(ids) - k)
                            if held >= 1 << 20:
                                yield batch(out)
                                out, held = [], 0
                if out:
                    yield batch(out)

    return docs.mapInArrow(run, EVENT)


def end_events(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", events: int = EVENTS) -> DataFrame:
    """The end events of both tokenizers, dealt by row of ``docs`` and sorted by offset.

    Rows are told apart by their place in the input, so ``docs`` should be read from files.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"))
    both = _side_events(rows, a, 0, events).unionByName(_side_events(rows, b, 1, events))
    return both.repartition("row").sortWithinPartitions("row", "first", "side")


class Groups(NamedTuple):
    """Closed groups in order: their ``ends``, the ids of both sides, and how many of them each group has."""

    ends: np.ndarray
    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray


class Sweep:
    """The machine over one document's events in order; holds nothing but the open group."""

    def __init__(self, widths: tuple[np.ndarray, np.ndarray]):
        self.widths, none = widths, np.empty(0, np.int64)
        self.ids, self.ends = [none] * 2, [none] * 2

    def feed(self, number: int, first: int, ids: np.ndarray) -> Groups | None:
        """A block of one side; the groups that it closes."""
        ends = np.cumsum(self.widths[number][ids])
        ends += first - ends[0]
        left = len(self.ids[number])
        self.ids[number] = np.concatenate([self.ids[number], ids]) if left else ids
        self.ends[number] = ends = np.concatenate([self.ends[number], ends]) if left else ends
        (a, b), (end_a, end_b) = self.ids, self.ends
        if not len(end_a) or not len(end_b):
            return None
        at_b = np.searchsorted(end_b, end_a)
        both = np.flatnonzero(end_b[np.minimum(at_b, len(end_b) - 1)] == end_a)
        if not len(both):
            return None
        at_b = at_b[both]
        cut_a, cut_b = both[-1] + 1, at_b[-1] + 1
        out = Groups(end_a[both], a[:cut_a], np.diff(both, prepend=-1), b[:cut_b], np.diff(at_b, prepend=-1))
        self.ids = [x[n:].copy() for x, n in ((a, cut_a), (b, cut_b))]
        self.ends = [x[n:].copy() for x, n in ((end_a, cut_a), (end_b, cut_b))]
        return out


def sweep(batches, widths, types):
    """(row, id, known, groups) over sorted event batches: first (.., None), then what closes; None as row at the end."""
    row = machine = None
    known = True
    for batch in batches:
        for r, key, number, first, fine, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "side", "first", "known", "ids")), strict=True):
            if r != row:
                row, machine, known = r, Sweep(widths), True
                yield row, key, True, None
            if first < 0:
                if not fine and known:
                    known = False
                    yield row, key, False, None
            elif known and (closed := machine.feed(number, first, np.frombuffer(ids, types[number]))) is not None:
                yield row, key, True, closed
    yield None, None, True, None


def links(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(a, b, times): all pairs within the groups; equal pairs may come more than once. None: once each."""
    at_a, at_b = np.cumsum(g.n_a) - g.n_a, np.cumsum(g.n_b) - g.n_b
    large = np.flatnonzero(g.n_a * g.n_b > PAIRED)
    each, start = np.repeat(g.n_b, g.n_a), np.repeat(at_b, g.n_a)
    for k in large.tolist():
        each[at_a[k] : at_a[k] + g.n_a[k]] = 0
    before = np.cumsum(each) - each
    a = np.repeat(g.a, each)
    b = g.b[np.repeat(start - before, each) + np.arange(len(a))]
    if not len(large):
        return a, b, None
    out = [(a, b, np.ones(len(a), np.int64))]
    for k in large.tolist():
        (ua, ca), (ub, cb) = (np.unique(x[at[k] : at[k] + n[k]], return_counts=True) for x, at, n in ((g.a, at_a, g.n_a), (g.b, at_b, g.n_b)))
        out.append((np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@lru_cache(maxsize=1)
def _spelled(n_a: int, n_b: int) -> list[str]:
    return [f"{i}{c}" for n, c in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]


def spell(g: Groups, n_a: int, n_b: int) -> str:
    """``a1,a2|b1;`` for every group."""
    end_a, end_b = np.cumsum(g.n_a), np.cumsum(g.n_b)
    word = np.empty(len(g.a) + len(g.b), np.int64)
    place_a = np.arange(len(g.a)) + np.repeat(end_b - g.n_b, g.n_a)
    place_b = np.arange(len(g.b)) + np.repeat(end_a, g.n_b)
    word[place_a], word[place_b] = g.a, g.b
    word[place_b] += 2 * n_a
    word[place_a[end_a - 1]] += n_a
    word[place_b[end_b - 1]] += n_b
    return "".join(map(_spelled(n_a, n_b).__getitem__, word.tolist()))


def aligned_groups(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, number, end, a_ids, b_ids): a row for each group of each document, in order of ``number``.

    ``row`` tells documents apart that share an id. What has no tokens has no groups.
    """

    def run(batches):
        widths, at = (lengths(a), lengths(b)), 0
        with task_tables("alignment"):
            for row, key, _, g in sweep(batches, widths, (id_type(a), id_type(b))):
                if g is None:
                    at = 0
                    continue
                parts = lambda ids, n: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
                n = len(g.ends)
                columns = [pa.array([row] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(np.arange(at, at + n)), pa.array(g.ends), parts(g.a, g.n_a), parts(g.b, g.n_b)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "number", "end", "a_ids", "b_ids"])
                at += n

    return end_events(docs, a, b, id_col, text_col).mapInArrow(run, "row long, id long, number long, end long, a_ids array<int>, b_ids array<int>").withColumnRenamed("id", id_col)


TOTALS = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _totals(events: DataFrame, a: str, b: str) -> DataFrame:
    """TOTALS of each document; ``pairs`` are distinct, as a * (number of B's ids) + b."""

    def run(batches):
        names = [part.split()[0] for part in TOTALS.split(", ")]
        types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        with task_tables("alignment"):
            widths = (lengths(a), lengths(b))
            n_a, n_b = map(len, widths)
            out, held = [], 0
            doc = known = digest = None
            count, pairs, times, waiting = [0] * 4, [], [], 0

            def merged():
                if not pairs:
                    return np.empty(0, np.int64), np.empty(0, np.int64)
                if all(t is None for t in times):
                    return np.unique(pairs[0] if len(pairs) == 1 else np.concatenate(pairs), return_counts=True)
                times[:] = [np.ones(len(p), np.int64) if t is None else t for p, t in zip(pairs, times, strict=True)]
                found, at = np.unique(np.concatenate(pairs), return_inverse=True)
                # Sums of whole numbers in doubles are exact below 2**53.
                return found, np.bincount(at, np.concatenate(times)).astype(np.int64)

            def close():
                found, n = merged() if known else (np.empty(0, np.int64),) * 2
                out.append((*doc, *(count if known else [0] * 4), digest.hexdigest() if known and count[2] else "", found, n))
                return len(found)

            for row, key, fine, g in sweep(batches, widths, (id_type(a), id_type(b))):
                if doc is None or row != doc[0]:
                    if doc is not None:
                        held += 8 + close()
                    if held >= 1 << 18 or (row is None and out):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
                    doc, known, digest = (row, key), True, hashlib.sha256()
                    count, pairs, times, waiting = [0] * 4, [], [], 0
                if not fine:
                    known = False
                if g is None or not known:
                    continue
                text = spell(g, n_a, n_b)[:-1]
                digest.update((";" + text if count[2] else text).encode())
                x, y, n = links(g)
                for k, more in enumerate((len(g.a), len(g.b), len(g.ends), len(x) if n is None else int(n.sum()))):
                    count[k] += more
                pairs.append(x.astype(np.int64) * n_b + y)
                times.append(n)
                waiting += len(x)
                if waiting > 1 << 20:
                    p, t = merged()
                    pairs, times, waiting = [p], [t], 0

    return events.mapInArrow(run, TOTALS)


def align_tokens(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    A pair's count is the number of rows of ``docs`` that hold it linked; ``n_best`` are
    the links whose count is the highest of their A token's, ``count_sum`` adds the
    counts of all links. Null and empty texts, and texts that either tokenizer does not
    spell back byte by byte, have zeros and an empty digest, and count for no pair. Rows
    that repeat an id, or wholly, are documents of their own; null ids stay. An empty
    table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    n_b = len(lengths(b))
    swept = scratch.table(_totals(end_events(docs, a, b, id_col, text_col), a, b), "swept")
    counts = swept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held"))
    counts = scratch.table(counts, "pair-counts")
    # At most one row for each id of A.
    best = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("held").alias("most"))
    marked = counts.withColumn("a", F.floor(F.col("pair") / n_b)).join(F.broadcast(best), "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best"))
    each = swept.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if counts.count() <= BROADCAST_PAIRS:
        met = each.join(F.broadcast(marked), "pair")
    else:
        met = join_spread(each, scratch.table(marked, "pair-marks"), "pair", "held", swept.count())
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = swept.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    return scratch.result(out, "aligned")
