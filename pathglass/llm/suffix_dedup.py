"""Removal of repeated passages by longest-previous-factor arrays (operator 5).

A byte goes if a string of ``length`` bytes around it also starts in a document
with a smaller id. That is where the longest previous factor of a start, its longest
match with an earlier document, reaches ``length``. In suffix order that match is
with the previous or the next start of an earlier document (the previous and next
smaller positions), and reaches as far as the common prefixes on the way there.

One suffix array over everything would not distribute, so starts are dealt to
buckets by content: every string of ``length`` bytes has an anchor, its 16-byte
factor with the smallest hash, and equal strings have equal anchors. Neighbouring
starts with one anchor travel together as one stretch of text.

1. Copies of whole texts go at once, found by their hashes; what follows leaves them out.
2. Each task lists its documents' anchors, each with the bytes before it and with those
   behind it, as short hashes; buckets tell which occur in more than one document, and
   which of them are hot.
3. Documents are cut into stretches around those anchors only. Of the copies of a
   stretch in one group of documents the first stands for all; the others go at once,
   so a passage that many documents hold sends one row for each group of documents.
4. A bucket builds the suffix and longest-previous-factor arrays of its stretches.
5. Marked stretches go back to their documents, whose bytes are removed.

What surrounds a hot passage still differs from document to document, all at the
passage's first and last anchors. Starts at hot anchors are therefore dealt by their
whole string instead, and only those whose string occurs in more than one document.

Tables between the steps are packed arrays in binary rows, not a row for each
anchor, and texts are shuffled as compressed packs of rows. The number of groups
follows the bytes of the input.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.llm.common import Scratch, join_spread, task_tables

LENGTH = 50
#: Bytes of an anchor.
FACTOR = 16
#: Bytes of text that the array code works on at a time; a few dozen times that is held meanwhile.
SLICE = 1 << 19
#: Anchors that a task holds before it hands them on.
FLUSH_ANCHORS = 6_000_000
#: Bytes of rows that a task holds before it packs them.
PACKED_BYTES = 32 << 20
#: Bytes of stretches that a task holds before it hands them on.
FLUSH_BYTES = 64 << 20

#: Bytes of text in a group of documents, and in a bucket, about.
GROUP_BYTES = 64 << 20
#: Starts that are sorted at once.
SORTED_STARTS = 1 << 18
#: Copies of whole texts that are left out of the search; what is beyond takes part.
COPIES = 1_000_000
#: Halves of stretches at one anchor from which on they are hot, at least.
HOT_STRETCHES = 1_000_000

_PLACE_BITS = np.uint64(22)
_PLACE_MASK = np.uint64((1 << 22) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes at every place as one integer; zeros behind the end.

    The integers overlap in memory, so they take no more than ``data``.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray(len(data), f"{order}u8", padded, strides=(1,))


def _at(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The integers at some places, in the machine's own byte order."""
    return words[places].astype(np.uint64, copy=False)


def slices(texts: list[bytes], length: int = LENGTH, size: int = SLICE):
    """Texts packed into buffers: (buffer, text numbers, places in the text, starts, ends in the buffer).

    A longer text continues in the next buffer, ``length - 1`` bytes overlapping.
    """
    parts, held = [], 0
    for number, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            take = min(len(text) - at, size)
            if held and held + take > size:
                yield _packed(parts)
                parts, held = [], 0
            parts.append((number, at, text[at : at + take]))
            held += take
            at += take if at + take == len(text) else take - length + 1
    if parts:
        yield _packed(parts)


def _packed(parts):
    ends = np.cumsum([len(x) for _, _, x in parts])
    starts = np.concatenate([[0], ends[:-1]])
    buffer = np.frombuffer(b"".join(x for _, _, x in parts), np.uint8)
    return buffer, np.array([n for n, _, _ in parts]), np.array([a for _, a, _ in parts]), starts, ends


def stretches(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(part, first start, number of starts, anchor hash) of the stretches with one anchor, in order."""
    return _anchored(buffer, starts, ends, length)[:4]


def _anchored(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """:func:`stretches`, and the place of each anchor."""
    w = _words(buffer, "<").astype(np.uint64)
    h = w * _M1 + np.concatenate([w[8:], np.zeros(min(8, len(w)), np.uint64)]) * _M2
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    # The smallest hash in each window of factors, the first place on a tie.
    low = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    span, want = 1, length - FACTOR + 1
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    if want > span:
        low = np.minimum(low[: span - want], low[want - span :]) if len(low) > want - span else low[:0]
    valid = np.zeros(len(buffer) + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, ends - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    anchor = (low[at] & _PLACE_MASK).astype(np.int64)
    new = np.empty(len(at), bool)
    new[:1] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return np.searchsorted(ends, at[first], "right"), at[first], count, h[anchor[first]], anchor[first]


def _keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash, and the 32 bits that tell hashes of a bucket apart."""
    return (h >> np.uint64(34)) % np.uint64(buckets), h & np.uint64(0xFFFFFFFF)


def halves(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, buckets: int):
    """(stretch, part, first start, number of starts, bucket, tag) of the halves of stretches, in order.

    Strings that hold ``side`` bytes at least before their anchor are the first half,
    and agree in these and the anchor; the others agree in the anchor and what follows.
    A tag is a hash of that much, as short factors recur by chance, the more often, the
    more text there is; the bucket is the anchor's.
    """
    part, first, count, h, anchor = _anchored(buffer, starts, ends, length)
    side = (length - FACTOR) // 2
    before = np.clip(anchor - side - first + 1, 0, count)
    n = np.column_stack([before, count - before])
    bucket, tag = np.repeat(_keys(h, buckets)[0], 2).reshape(n.shape), np.zeros(n.shape, np.uint64)
    for k, (shift, size) in enumerate([(side, FACTOR + side), (0, length - side + 1)]):
        some = np.flatnonzero(n[:, k])
        tag[some, k] = _keys(_whole_strings(buffer, anchor[some] - shift, size), buckets)[1]
    some = np.flatnonzero(n.ravel())
    stretch = some // 2
    begin = np.column_stack([first, first + before])
    return stretch, part[stretch], *(x.ravel()[some] for x in (begin, n, bucket, tag))


def _rows(groups: np.ndarray, columns: list[np.ndarray]):
    """For each group (ascending), its number and the packed slice of every column; groups must be sorted."""
    cuts = np.flatnonzero(np.diff(groups)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
        if b > a:
            yield int(groups[a]), [c[a:b].tobytes() for c in columns]


def _packed_numbers(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed; small ones take little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _numbers(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _among(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys stand in the sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of ranges given by their first place and their length."""
    out = np.repeat(first - (np.cumsum(count) - count), count)
    out += np.arange(len(out))
    return out


def _whole_strings(buffer: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each place."""
    w, h = _words(buffer, "<"), np.full(len(at), length, np.uint64)
    for s in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ _at(w, at + s)) * _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ h >> np.uint64(32)


def _lists(rows: DataFrame, buckets: int, length: int, hot: np.ndarray | None = None) -> DataFrame:
    """(bucket, tags, batches, counts): how many documents of a task's batches hold what a tag stands for.

    With ``hot`` (sorted keys of halves) the same for the whole strings at these. Tags
    ascend and stand as steps.
    """
    small = np.uint16 if buckets <= 1 << 16 else np.uint32

    def flush(held):
        tag, bucket, batch = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((batch, tag, bucket))
        tag, bucket, batch = tag[order], bucket[order], batch[order]
        new = np.ones(len(tag), bool)
        new[1:] = (tag[1:] != tag[:-1]) | (bucket[1:] != bucket[:-1]) | (batch[1:] != batch[:-1])
        at = np.flatnonzero(new)
        count = np.minimum(np.diff(np.append(at, len(tag))), 255).astype(np.uint8)
        cuts = np.flatnonzero(np.diff(bucket[at])) + 1
        for own in np.split(np.arange(len(at)), cuts):
            blobs = [_packed_numbers(x) for x in (np.diff(tag[at[own]], prepend=tag.dtype.type(0)), batch[at[own]], count[own])]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[at[own[0]]])], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["bucket", "tags", "batches", "counts"])

    def run(batches):
        with task_tables("suffixes"):
            yield from listed(batches)

    def listed(batches):
        held, n = [], 0
        for b in batches:
            texts = [(x.as_py() or "").encode() for x in b.column("text")]
            batch_of = b.column("batch").to_numpy(zero_copy_only=False)
            for buffer, number, _, starts, ends in slices(texts, length):
                _, part, first, count, bucket, tag = halves(buffer, starts, ends, length, buckets)
                if hot is not None:
                    got = _among(hot, bucket << np.uint64(32) | tag)
                    part = np.repeat(part[got], count[got])
                    bucket, tag = _keys(_whole_strings(buffer, _places(first[got], count[got]), length), buckets)
                doc = number[part]
                # A document counts once for each of its anchors.
                order = np.lexsort((tag, bucket, doc))
                doc, bucket, tag = doc[order], bucket[order], tag[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1]) | (tag[1:] != tag[:-1])
                held.append((tag[new].astype("<u4"), bucket[new].astype(np.int32), batch_of[doc[new]].astype(small)))
                n += int(new.sum())
                if n >= FLUSH_ANCHORS:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return rows.select("batch", "text").mapInArrow(run, "bucket int, tags binary, batches binary, counts binary")


def _shared(lists: DataFrame, buckets: int, hot_from: int | None = None) -> DataFrame:
    """(batch, bucket, tags): what of the lists occurs in more than one document, by batch.

    Tags that ``hot_from`` documents or more hold stand under batch -1 instead.
    """
    small = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(table: pa.Table) -> pa.Table:
        with task_tables("suffixes"):
            return told(table)

    def told(table):
        tag = np.concatenate([np.cumsum(_numbers(x.as_py(), "<u4"), dtype=np.uint32) for x in table.column("tags")])
        batch, count = (np.concatenate([_numbers(x.as_py(), t) for x in table.column(c)]) for c, t in (("batches", small), ("counts", np.uint8)))
        order = np.lexsort((batch, tag))
        tag, batch, count = tag[order], batch[order].astype(np.int64), count[order]
        new = np.ones(len(tag), bool)
        new[1:] = tag[1:] != tag[:-1]
        at = np.flatnonzero(new)
        total = np.repeat(np.add.reduceat(count, at, dtype=np.int64), np.diff(np.append(at, len(tag))))
        if hot_from is not None:
            batch[total >= hot_from] = -1
        new[1:] |= batch[1:] != batch[:-1]  # each batch is told once
        take = new & (total > 1)
        tag, batch = tag[take], batch[take]
        order = np.argsort(batch, kind="stable")
        got = list(_rows(batch[order], [tag[order]]))
        number = table.column("bucket")[0].as_py()
        return pa.table({"batch": pa.array([g[0] for g in got], pa.int32()), "bucket": pa.array([number] * len(got), pa.int32()), "tags": pa.array([g[1][0] for g in got], pa.binary())})

    return lists.groupBy("bucket").applyInArrow(run, "batch int, bucket int, tags binary")


def _full_keys(bucket: int, tags: bytes) -> np.ndarray:
    return np.frombuffer(tags, "<u4").astype(np.uint64) | np.uint64(bucket << 32)


def _in_packs(rows: DataFrame, key: str) -> DataFrame:
    """(key, packed): the rows of one key that a task holds, compressed together, as texts are most of what is shuffled."""

    def flush(held):
        table = pa.Table.from_batches(held)
        number = table.column(key).to_numpy()
        order = np.argsort(number, kind="stable")
        number, table = number[order], table.take(pa.array(order))
        cuts = np.flatnonzero(np.diff(number)) + 1
        zip_ = zstandard.ZstdCompressor(level=3)
        for a, b in pairwise([0, *cuts.tolist(), len(number)]):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as stream:
                stream.write_table(table.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([int(number[a])], pa.int32()), pa.array([zip_.compress(out.getvalue())], pa.binary())], [key, "packed"])

    def run(batches):
        with task_tables("suffixes"):
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= PACKED_BYTES:
                    yield from flush(held)
                    held, size = [], 0
            if size:
                yield from flush(held)

    return rows.mapInArrow(run, f"{key} int, packed binary")


def _unpacked(packs: pa.Table) -> pa.Table:
    unzip = zstandard.ZstdDecompressor()
    return pa.concat_tables(pa.ipc.open_stream(unzip.decompress(x.as_py())).read_all() for x in packs.column("packed"))


_STRETCH = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<i8"), ("count", "<u2")])
#: A range of bytes to remove from the rows with this document id and hash.
_MARK = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<i8"), ("end", "<i8")])


def _whole_marks(heads: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(heads), _MARK)
    out["doc"], out["row"], out["at"] = heads["doc"], heads["row"], heads["at"]
    out["end"] = heads["at"] + heads["count"] + length - 1
    return out


def _cut_stretches(rows: DataFrame, shared: DataFrame, buckets: int, length: int, hot: np.ndarray) -> DataFrame:
    """(bucket, heads, texts, batch, marks): the stretches that a bucket is to judge, and what a batch has decided."""

    def flush(batch, held):
        bucket = np.concatenate([x[0] for x in held])
        heads = np.concatenate([x[1] for x in held])
        texts = [t for x in held for t in x[2]]
        zip_ = zstandard.ZstdCompressor(level=1)
        own, first = _distinct(texts, heads["doc"], {})
        later = first[own] < heads["doc"]
        numbers, blobs, packed, at = [], [], [], 0
        left = np.flatnonzero(~later)
        left = left[np.argsort(bucket[left], kind="stable")]
        for number, (blob,) in _rows(bucket[left], [heads[left]]):
            n = len(blob) // _STRETCH.itemsize
            numbers.append(number)
            blobs.append(zip_.compress(blob))
            packed.append(zip_.compress(b"".join(texts[k] for k in left[at : at + n])))
            at += n
        n = len(numbers)
        marks = zip_.compress(_whole_marks(heads[later], length).tobytes())
        columns = [(numbers + [batch % buckets], pa.int32()), (blobs + [None], pa.binary()), (packed + [None], pa.binary()), ([None] * n + [batch], pa.int32()), ([None] * n + [marks], pa.binary())]
        return pa.table({c: pa.array(x, t) for c, (x, t) in zip(["bucket", "heads", "texts", "batch", "marks"], columns, strict=True)})

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        with task_tables("suffixes"):
            return stretched(docs, shared)

    def stretched(docs, shared):
        known = [_full_keys(k.as_py(), t.as_py()) for k, t in zip(shared.column("bucket"), shared.column("tags"), strict=True)]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        held, size, out = [], 0, []
        batch = docs.column("batch")[0].as_py() if docs.num_rows else 0
        if len(known) and docs.num_rows:
            docs = _unpacked(docs)
            texts = [(x.as_py() or "").encode() for x in docs.column("text")]
            ids, keys = docs.column("id").to_numpy(), docs.column("row").to_numpy()

            def cut(buffer, number, places, starts, part, first, count, bucket):
                heads = np.empty(len(part), _STRETCH)
                heads["doc"], heads["row"] = ids[number[part]], keys[number[part]]
                heads["at"], heads["count"] = places[part] + first - starts[part], count
                raw = buffer.tobytes()
                return bucket.astype(np.int32), heads, [raw[a:b] for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)]

            for buffer, number, places, starts, ends in slices(texts, length):
                stretch, part, first, count, bucket, tag = halves(buffer, starts, ends, length, buckets)
                full = bucket << np.uint64(32) | tag
                single = _among(hot, full)
                got = np.flatnonzero(_among(known, full) & ~single)
                if len(got):  # both halves of a stretch travel as one
                    new = np.flatnonzero(np.diff(stretch[got], prepend=-1))
                    n, got = np.add.reduceat(count[got], new), got[new]
                    held.append(cut(buffer, number, places, starts, part[got], first[got], n, bucket[got]))
                    size += int(n.sum()) + (length - 1) * len(got)
                if single.any():
                    at, part = _places(first[single], count[single]), np.repeat(part[single], count[single])
                    bucket, tag = _keys(_whole_strings(buffer, at, length), buckets)
                    got = np.flatnonzero(_among(known, bucket << np.uint64(32) | tag))
                    held.append(cut(buffer, number, places, starts, part[got], at[got], np.ones(len(got), np.int64), bucket[got]))
                    size += length * len(got)
                if size >= FLUSH_BYTES:
                    out.append(flush(batch, held))
                    held, size = [], 0
        if held or not out:
            out.append(flush(batch, held or [(np.zeros(0, np.int32), np.zeros(0, _STRETCH), [])]))
        return pa.concat_tables(out)

    left = _in_packs(rows.select("batch", "id", "row", "text"), "batch").groupBy("batch")
    return left.cogroup(shared.groupBy("batch")).applyInArrow(run, "bucket int, heads binary, texts binary, batch int, marks binary")


def _distinct(texts: list[bytes], docs: np.ndarray, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Fills ``ids`` with the distinct texts; the number of each text, and the smallest document of each number."""
    own = np.array([ids.setdefault(t, len(ids)) for t in texts], np.int64)
    first = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(first, own, docs)
    return own, first


def _reach(docs: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """How far each suffix matches the previous smaller position, the nearest one before it of an earlier document.

    ``common[i]`` is the common prefix of suffixes i - 1 and i; matches under
    ``least`` count as 0. All suffixes look at once: where the one looked at is not
    earlier, its own look goes further back, and so does this one.
    """
    at, reach = np.arange(len(docs)) - 1, common.copy()
    open_ = np.flatnonzero(reach >= least)
    while len(open_):
        seen = at[open_]
        go = docs[seen] >= docs[open_]
        open_, seen = open_[go], seen[go]
        further, shorter = at[seen], np.minimum(reach[open_], reach[seen])
        at[open_], reach[open_] = further, shorter
        open_ = open_[shorter >= least]
    return np.where(reach >= least, reach, 0)


def longest_previous_factors(data: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int = LENGTH, at_once: int = SORTED_STARTS) -> np.ndarray:
    """For each start ``at`` in ``data``, its longest match with a start of a smaller document.

    Matches are followed up to ``length`` bytes; shorter ones remove nothing and
    read 0. The starts are sorted into suffix order, which their first ``length``
    bytes decide; each one's longest match is with its previous or with its next
    smaller position there. Starts that match agree in their first 8 bytes, so
    many starts are dealt by these and sorted about ``at_once`` at a time.
    """
    w = _words(data, ">")
    if len(at) <= at_once:
        return _sorted_factors(w, at, docs, length)
    parts = min(-(-len(at) // at_once) * 2, 1 << 16)
    part = np.empty(len(at), np.uint16)
    for k in range(0, len(at), at_once):
        h = _at(w, at[k : k + at_once]) * _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        h >>= np.uint64(32)
        part[k : k + at_once] = h % np.uint64(parts)
    ends = np.cumsum(np.bincount(part, minlength=parts))
    # The starts in order of their parts, a slice of them at a time.
    order, place = np.empty(len(at), np.min_scalar_type(len(at))), np.append(0, ends[:-1])
    for k in range(0, len(at), at_once):
        own = np.argsort(part[k : k + at_once], kind="stable")
        n = np.bincount(part[k : k + at_once], minlength=parts)
        order[_places(place, n)] = own + k
        place += n
    del part
    out = np.empty(len(at), np.min_scalar_type(length))
    for a, b in pairwise([0, *ends.tolist()]):
        own = order[a:b]
        out[own] = _sorted_factors(w, at[own], docs[own], length)
    return out


def _sorted_factors(w: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """:func:`longest_previous_factors` of starts that are sorted together; ``w`` holds the 8 bytes at every place."""
    steps = [*range(0, length - 8, 8), length - 8]
    keys, order = [_at(w, at + s) for s in steps], np.arange(len(at))
    for k in reversed(keys):  # a key at a time, the last one first
        order = order[np.argsort(k[order], kind="stable")]
    equal = np.ones(len(at), bool)
    equal[:1] = False
    for k in keys:
        k = k[order]
        equal[1:] &= k[1:] == k[:-1]
    del keys, k
    common, docs = np.where(equal, length, 0), docs[order]
    out = np.empty(len(at), np.int64)
    before = _reach(docs, common, length)
    behind = _reach(docs[::-1], np.append(0, common[:0:-1])[: len(at)], length)[::-1]
    out[order] = np.maximum(before, behind)
    return out


def _marks(cut: DataFrame, buckets: int, length: int) -> DataFrame:
    """(batch, marks): byte ranges to remove, by row."""

    def run(table: pa.Table) -> pa.Table:
        with task_tables("suffixes"):
            return judged(table)

    def judged(table):
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        ids: dict[bytes, int] = {}  # distinct stretches of the bucket
        heads, own, firsts, batches, blobs = [], [], [], [], []
        for head, text, batch, decided in zip(*(table.column(c) for c in ("heads", "texts", "batch", "marks")), strict=True):
            if head.as_py() is None:
                batches.append(batch.as_py())
                blobs.append(decided.as_py())
                continue
            head = np.frombuffer(unzip.decompress(head.as_py()), _STRETCH)
            text = unzip.decompress(text.as_py())
            ends = np.cumsum(head["count"].astype(np.int64) + length - 1).tolist()
            numbers, first = _distinct([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], head["doc"], ids)
            heads.append(head)
            own.append(numbers)
            firsts.append(first)
        if heads:
            heads, own = np.concatenate(heads), np.concatenate(own)
            first = np.full(len(ids), np.iinfo(np.int64).max)
            for part in firsts:
                np.minimum(first[: len(part)], part, out=first[: len(part)])
            data = np.frombuffer(b"".join(ids), np.uint8)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            ids.clear()
            begin, n = np.cumsum(n) - n, n - length + 1
            # Every start of every distinct stretch, for the first document that has the stretch; ranks tell documents apart.
            rank = np.unique(first, return_inverse=True)[1].astype(np.int32)
            hit = longest_previous_factors(data, _places(begin, n), np.repeat(rank, n), length) >= length
            offset = np.cumsum(n) - n
            stretch = np.repeat(np.arange(len(n), dtype=np.int32), n)
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1] | (stretch[1:] != stretch[:-1])
            closes[:-1] &= ~hit[1:] | (stretch[1:] != stretch[:-1])
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
            later = first[own] < heads["doc"]
            rest = np.flatnonzero(~later)
            low, high = (np.searchsorted(stretch[opens], own[rest], side) for side in ("left", "right"))
            run_at, of = _places(low, high - low), np.repeat(rest, high - low)
            part = np.empty(len(of), _MARK)
            part["doc"], part["row"] = heads["doc"][of], heads["row"][of]
            part["at"] = heads["at"][of] + opens[run_at] - offset[own[of]]
            part["end"] = heads["at"][of] + closes[run_at] - offset[own[of]] + length
            marks = np.concatenate([_whole_marks(heads[later], length), part])
            group = marks["row"] % buckets
            order = np.lexsort((marks["at"], marks["row"], group))
            for number, (blob,) in _rows(group[order], [marks[order]]):
                batches.append(number)
                blobs.append(zip_.compress(blob))
        return pa.table({"batch": pa.array(batches, pa.int32()), "marks": pa.array(blobs, pa.binary())})

    return cut.select("bucket", "heads", "texts", "batch", "marks").groupBy("bucket").applyInArrow(run, "batch int, marks binary")


def _copies(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(batch, id, row, n_bytes) of rows whose whole text an earlier document has: all of them goes, without a search."""
    rows = rows.select("batch", "id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))
    texts = rows.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size"))
    texts = scratch.table(texts.filter("first < last").drop("last"), "copied")
    total = texts.agg(F.sum("size")).first()[0] or 0
    return join_spread(rows, texts, "sha", "size", total).filter("id > first").select("batch", "id", "row", "n_bytes")


def _copy_marks(copies: DataFrame) -> DataFrame:
    """(batch, marks) for whole rows."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            number, marks = b.column("batch").to_numpy(), np.zeros(b.num_rows, _MARK)
            for name, c in (("doc", "id"), ("row", "row"), ("end", "n_bytes")):
                marks[name] = b.column(c).to_numpy()
            order = np.argsort(number, kind="stable")
            got = [(k, zip_.compress(blob)) for k, (blob,) in _rows(number[order], [marks[order]])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["batch", "marks"])

    return copies.mapInArrow(run, "batch int, marks binary")


def merged(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by ranges sorted by ``at``; touching ranges join."""
    if not len(at):
        return at, end
    reach = np.maximum.accumulate(end)
    cuts = np.flatnonzero(at[1:] > reach[:-1])
    return at[np.append(0, cuts + 1)], reach[np.append(cuts, len(at) - 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, hot: int = HOT_STRETCHES, figures_as: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256")) -> DataFrame:
    """``docs`` without its repeated bytes, and n_bytes, n_removed, n_spans, kept_sha256 (or ``figures_as``) behind its columns.

    With ``keep_text`` the text column holds what is left, half characters at the
    cuts dropped; without it only the id column and the four figures return. Null
    and short texts stay as they are (0 bytes if null). A null id is neither earlier
    nor later than any, so such rows lose nothing. Rows with one id are no earlier
    than each other; repeated rows get the same result. Extra columns pass through,
    whatever their names. ``length`` must be 24 at least. Anchors that ``hot``
    documents hold (more in very large inputs, so that they stay under 2 million)
    are split by whole strings.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    row = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(id_col).cast("long"), text_col), 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row.alias("row"))
    rows = rows.withColumn("batch", (F.col("row") % buckets).cast("int"))
    takes_part = rows.filter(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    scratch = Scratch(spark)
    copies = scratch.table(_copies(takes_part, scratch), "copies")
    searched = takes_part.join(F.broadcast(copies.select("id", "row").limit(COPIES)), ["id", "row"], "left_anti")
    # An anchor spans 18 bytes on average, so the driver takes a bounded number of hot ones.
    shared = scratch.table(_shared(_lists(searched, buckets, length), buckets, max(hot, size >> 25)), "shared-halves")
    found = [_full_keys(r["bucket"], r["tags"]) for r in shared.filter("batch = -1").collect()]
    found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    shared = shared.filter("batch >= 0")
    if len(found):
        shared = shared.unionByName(scratch.table(_shared(_lists(searched, buckets, length, found), buckets), "shared-strings"))
    marks = _marks(_cut_stretches(searched, shared, buckets, length, found), buckets, length)
    marks = scratch.result(marks.unionByName(_copy_marks(copies)), "marks")

    figures = [pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("kept_sha256", pa.string())]
    carried = docs.columns if keep_text else [id_col]
    fields = [docs.schema[c] for c in carried]
    left = docs.select(*(F.col(c).alias(f"__c{k}") for k, c in enumerate(carried)), F.col(text_col).alias("__text"), F.col(id_col).cast("long").alias("__doc"), row.alias("__row"), (row % buckets).cast("int").alias("__batch"))

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        with task_tables("suffixes"):
            return removed_from(docs, marks)

    def removed_from(docs, marks):
        docs = _unpacked(docs)
        unzip = zstandard.ZstdDecompressor()
        got = [np.frombuffer(unzip.decompress(x.as_py()), _MARK) for x in marks.column("marks")]
        got = np.concatenate(got) if got else np.zeros(0, _MARK)
        got = got[np.lexsort((got["at"], got["row"], got["doc"]))]
        # A mark belongs to an id and a hash, so rows of different ids never share one.
        new = np.ones(len(got), bool)
        new[1:] = (got["doc"][1:] != got["doc"][:-1]) | (got["row"][1:] != got["row"][:-1])
        cuts = np.flatnonzero(new)
        own = dict(zip(zip(got["doc"][cuts].tolist(), got["row"][cuts].tolist(), strict=True), pairwise([*cuts.tolist(), len(got)]), strict=True))
        places = [own.get(key, (0, 0)) for key in zip(docs.column("__doc").to_pylist(), docs.column("__row").to_pylist(), strict=True)]
        size, removed, spans, sha, texts = [], [], [], [], []
        for text, (a, b) in zip(docs.column("__text"), places, strict=True):
            text = text.as_py()
            data = (text or "").encode()
            starts, ends = merged(got["at"][a:b], got["end"][a:b])
            kept = data if a == b else b"".join(data[x:y] for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
            size.append(len(data))
            removed.append(len(data) - len(kept))
            spans.append(len(starts))
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(text if a == b else kept.decode("utf-8", "ignore"))
        columns = {f"__c{k}": pa.array(texts, pa.string()) if keep_text and c == text_col else docs.column(f"__c{k}") for k, c in enumerate(carried)}
        return pa.table(columns | {f.name: pa.array(x, f.type) for f, x in zip(figures, (size, removed, spans, sha), strict=True)})

    schema = ", ".join([*(f"__c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    out = _in_packs(left, "__batch").groupBy("__batch").cogroup(marks.withColumnRenamed("batch", "__batch").groupBy("__batch")).applyInArrow(run, schema)
    return out.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(carried)), *(F.col(f.name).alias(c) for f, c in zip(figures, figures_as, strict=True)))
