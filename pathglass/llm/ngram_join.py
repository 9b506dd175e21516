"""N-gram Jaccard join by size-aware heavy and light sets (operator 13).

Documents become sets of hashed word shingles; equal sets are one from the start. All
sets are put into one order of shingles, rare ones first, which a fixed-size table of
counts gives. Two sets that overlap enough share as many of their first shingles, so
that only a prefix of each is looked at. Small (light) sets enumerate all subsets of two
shingles of it, and those with a subset in common are compared. Large (heavy) sets,
whose subsets are too many, scan the inverted lists of their single prefix shingles.
The size that parts them is where the estimated work is least. A list too long to
compare grows its subsets by a further shingle, by which no link is lost.

Before texts are fetched, bitmaps of the sets rule out pairs that differ in too many
shingles; that is a bound, not an estimate. What is left of a list is compared exactly,
on full sets. A list yields a spanning forest of its links, and
lists within one component are dropped, so that a group of copies costs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.llm.bitmaps import WIDE, bitmap, candidate_groups, in_blocks
from pathglass.llm.chosen_path import WORDS, _mix, components
from pathglass.llm.common import HOT_KEYS, Scratch, join_spread, task_tables, text_stream

#: Lists of at most so many sets are compared as they are; once components are known, of 4 * WIDE
#: times as many by bitmaps, as a further shingle costs a set a row for each shingle of its prefix.
LEAF = 256
#: Cells of the table of counts that orders shingles, and the slices it is summed in: a fixed size.
CELLS, SLICES = 1 << 22, 64
#: Shingles of a subset at most, beyond which a long list is compared block by block.
DEEPEST = 4
#: Lists of each set that are compared first, and how often, to find most components before all others are looked at.
CHOSEN, ROUNDS = 3, 2
#: What a row of a subset costs, in entries of lists scanned.
ROW = 8
#: Sizes told apart when the boundary is chosen; larger sets count as this size.
SIZES = 4_096


#: Odd factors of the words of a shingle.
_PLACES = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending; with fewer words the whole sequence as one."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode().lower().split()), np.uint64)
    if not len(w):
        return w
    size = min(len(w), words)
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += w[k : k + n] * _PLACES[k % len(_PLACES)] + np.uint64(k // len(_PLACES))
    h = np.sort(_mix(h))
    return h[np.append(True, h[1:] != h[:-1])]


def needed(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any set it links with, at least."""
    return -(-percent * n // 100)


def prefix(n: int, share: int, percent: int) -> int:
    """So many of its first shingles hold ``share`` common ones of every linked pair."""
    return min(n, n - needed(n, percent) + share)


def _described(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, key, packed, slice, counts): a row for each document, key naming its set and packed its compressed
    text, and for each task SLICES rows of its counts of shingles."""

    def run(batches):
        with task_tables("shingles"):
            zip_ = zstandard.ZstdCompressor(level=1)
            total = np.zeros(CELLS, np.uint32)
            names = ["id", "n", "key", "packed", "slice", "counts"]
            for b in batches:
                n, key, packed = [], [], []
                for text in text_stream(b, "__text"):
                    found = shingles(text, words)
                    np.add.at(total, (found & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
                    n.append(len(found))
                    key.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    packed.append(zip_.compress(text.encode()) if len(found) else None)
                none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(packed, pa.binary()), *none], names)
            parts = [zip_.compress(x.tobytes()) for x in np.split(total, SLICES)]
            none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, "id long, n long, key binary, packed binary, slice int, counts binary")


def _summed(tables: DataFrame) -> np.ndarray:
    """Steps of the logarithm of each cell's count: CELLS bytes, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(CELLS // SLICES, np.int64), 0
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            part = b.column("slice")[0].as_py()
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(unzip.decompress(x), np.uint32)
        steps = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([steps.tobytes()], pa.binary())], ["slice", "steps"])

    found = tables.groupBy("slice").applyInArrow(run, "slice int, steps binary").collect()
    out = {r["slice"]: r["steps"] for r in found}
    return np.frombuffer(b"".join(out.get(k, bytes(CELLS // SLICES)) for k in range(SLICES)), np.uint8)


def _ordered(sets: DataFrame, steps: np.ndarray, percent: int, words: int) -> DataFrame:
    """``sets`` with the prefix for DEEPEST shared shingles in the common order, the work of scanning its lists, and a bitmap."""
    table = sets.sparkSession.sparkContext.broadcast(steps)

    def run(batches):
        with task_tables("shingles"):
            unzip = zstandard.ZstdDecompressor()
            usual = 2.0 ** (float(np.mean(table.value)) / 8)
            for b in batches:
                first, work, bits = [], [], []
                for n, packed in zip(b.column("n").to_pylist(), b.column("packed").to_pylist(), strict=True):
                    found = shingles(unzip.decompress(packed).decode(), words)
                    step = table.value[(found & np.uint64(CELLS - 1)).astype(np.int64)]
                    order = np.lexsort((found, step))[: prefix(n, DEEPEST, percent)]
                    first.append(found[order].tobytes())
                    bits.append(bitmap(found))
                    alone = prefix(n, 1, percent)
                    work.append(int((ROW + np.maximum(0, 2.0 ** (step[order[:alone]] / 8) - usual) * alone / n).sum()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("num", "key", "first", "copies", "n", "packed")), pa.array(first, pa.binary()), pa.array(work, pa.int64()), pa.array(bits, pa.binary())], ["num", "key", "first", "copies", "n", "packed", "prefix", "work", "bits"])

    return sets.mapInArrow(run, "num long, key binary, first long, copies long, n long, packed binary, prefix binary, work long, bits binary")


def boundary(sizes: list[tuple[int, int, int]], percent: int) -> int:
    """The size up to which sets are light: least work over (size, sets, work of scanning).

    A light set of ``n`` makes a row for each subset of two; sets above the share
    ``percent`` of the boundary are in the lists of heavy ones too.
    """
    sizes = sorted(sizes)
    light, heavy = 0, sum(w for _, _, w in sizes)
    best = (heavy, 0)
    for n, sets, work in sizes:
        light += ROW * sets * comb(prefix(n, 2, percent), 2)
        heavy -= work
        best = min(best, (light + heavy, n))
    return best[1]


def _grow(rows: DataFrame, percent: int, bound: int | None = None) -> DataFrame:
    """(node, num, tag) of subsets. Without ``bound`` one shingle more than those of ``rows`` (node, tag, num, n,
    prefix); with it the first ones of sets: pairs of light sets, singles for heavy ones. The tag holds the place
    of a subset's last shingle, how many it has, and whether it is a list that heavy sets scan."""

    def run(batches):
        for b in batches:
            nodes, take, tags = [], [], []
            known = [b.column(c).to_pylist() for c in ("node", "tag")] if bound is None else None
            for k, (n, data) in enumerate(zip(b.column("n").to_pylist(), b.column("prefix").to_pylist(), strict=True)):
                p = np.frombuffer(data, np.uint64)
                made = []
                if bound is None:
                    tag = known[1][k]
                    s = (tag >> 1 & 7) + 1
                    j = np.arange((tag >> 4) + 1, prefix(n, s, percent))
                    made.append((_mix(p[j] ^ _mix(np.full(len(j), known[0][k], np.int64).view(np.uint64))), j, s, tag & 1))
                else:
                    if n <= bound:
                        i, j = np.triu_indices(prefix(n, 2, percent), 1)
                        made.append((_mix(p[j] ^ _mix(_mix(p[i]))), j, 2, 0))
                    if 100 * n >= percent * (bound + 1):
                        j = np.arange(prefix(n, 1, percent))
                        made.append((_mix(p[j]), j, 1, 1))
                for node, j, s, scans in made:
                    nodes.append(node.view(np.int64))
                    take.append(np.full(len(j), k, np.int32))
                    tags.append((j << 4 | s << 1 | scans).astype(np.int32))
                if sum(map(len, nodes)) >= 1 << 18 or k == b.num_rows - 1:
                    if nodes:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), b.column("num").take(pa.array(np.concatenate(take))), pa.array(np.concatenate(tags))], ["node", "num", "tag"])
                    nodes, take, tags = [], [], []

    return rows.mapInArrow(run, "node long, num long, tag int")


def link_sets(nums: list[int], sets: list[np.ndarray], pivots: list[bool], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of which an end is a pivot, as pairs of ``nums``."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    comp, out = np.arange(len(sets)), []
    mine = np.zeros(int(token.max()) + 1, bool)
    for i in np.flatnonzero(pivots).tolist():
        if (comp == comp[0]).all():
            break
        own = token[starts[i] : starts[i] + size[i]]
        mine[own] = True
        common = np.add.reduceat(mine[token].astype(np.int32), starts)
        mine[own] = False
        linked = (100 * common >= percent * (size[i] + size - common)) & (comp != comp[i])
        for c in np.unique(comp[linked]).tolist():
            j = int(np.flatnonzero(linked & (comp == c))[0])
            out.append((min(nums[i], nums[j]), max(nums[i], nums[j])))
            comp[comp == c] = comp[i]
    return out


def _once(lists: DataFrame) -> DataFrame:
    """Equal lists once, under a name: sets that are alike share very many subsets."""
    name = F.sha2(F.array_join(F.transform("members", lambda x: x.cast("string")), ","), 256)
    return lists.filter(F.size("members") > 1).groupBy(name.alias("list")).agg(F.first("members").alias("members"), F.bool_and("scan").alias("scan"))


def _pruned(lists: DataFrame, facts: DataFrame, percent: int, leaf: int) -> DataFrame:
    """What is left of lists (members, scan) by ``facts`` (num, n, bits, component): groups of members that may link."""
    rows = facts.join(_once(lists).select("list", "scan", F.explode("members").alias("num")), "num")

    def run(table: pa.Table) -> pa.Table:
        num = np.array(table.column("num").to_pylist(), np.int64)
        order = np.argsort(num)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(num), -1)[order]
        size, component = (table.column(c).to_numpy()[order] for c in ("n", "component"))
        found = [num[order][part].tolist() for g in candidate_groups(size, bits, component, percent) for part in in_blocks(g, leaf)]
        scan = table.column("scan")[0].as_py()
        return pa.table({"members": pa.array(found, pa.list_(pa.int64())), "scan": pa.array([scan] * len(found), pa.bool_())})

    return rows.groupBy("list").applyInArrow(run, "members array<long>, scan boolean")


def _compared(lists: DataFrame, sets: DataFrame, bound: int, percent: int, words: int) -> DataFrame:
    """(a, b): links that join all linked sets of each list (members, scan); in scanned ones an end is heavy."""
    lists = _once(lists)
    rows = sets.select("num", "packed").join(lists.select("list", "scan", F.explode("members").alias("num")).hint("merge"), "num").select("list", "scan", "num", "packed")

    def run(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        texts = dict(zip(table.column("num").to_pylist(), table.column("packed").to_pylist(), strict=True))
        nums = sorted(texts)
        found = [shingles(unzip.decompress(texts[k]).decode(), words) for k in nums]
        scan = table.column("scan")[0].as_py()
        got = link_sets(nums, found, [not scan or len(x) > bound for x in found], percent)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    return rows.groupBy("list").applyInArrow(run, "a long, b long").distinct()


_lists = lambda rows: rows.groupBy("node").agg(F.sort_array(F.collect_set("num")).alias("members"), F.bool_and(F.col("tag") % 2 == 1).alias("scan")).select("members", "scan")


def _shared(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, int]:
    """Written rows of the nodes that several sets are in, with their ``size``; and the number of ``rows``."""
    total = rows.count()
    counts = scratch.table(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "list-sizes")
    # Rows and sizes meet by a shuffle whatever their number; only the longest lists' sizes are broadcast.
    long = counts.filter(F.col("size") >= max(1_000, total // HOT_KEYS))
    usual = rows.join(F.broadcast(long.select("node")), "node", "left_anti").join(counts.hint("merge"), "node")
    return scratch.table(usual.unionByName(rows.join(F.broadcast(long), "node")), "lists"), total


def _chosen(rows: DataFrame, round_: int) -> DataFrame:
    """Of each set's ``rows`` the CHOSEN with the smallest hashes: sets that share many lists choose the same ones."""
    pick = lambda k: F.min_by(F.struct("node", "tag"), F.xxhash64("node", F.lit(CHOSEN * round_ + k)))
    taken = rows.groupBy("num").agg(F.array_distinct(F.array(*map(pick, range(CHOSEN)))).alias("c"))
    taken = taken.select("num", F.explode("c").alias("c")).select("num", "c.node", "c.tag")
    sizes = taken.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    return taken.join(sizes.hint("merge"), "node").select("node", "num", "tag", "size").filter("size > 1")


def _chunked(rows: DataFrame, leaf: int) -> DataFrame:
    """Long lists in chunks, each with the list's smallest set: a first, linear look at them."""
    n = F.ceil(F.col("size") / leaf).cast("int")
    own = rows.select("node", "num", "tag", F.pmod(F.xxhash64("num", "node"), n).cast("int").alias("chunk"))
    pivots = rows.groupBy("node").agg(F.min("num").alias("num"), F.min("tag").alias("tag"), F.max(n).alias("n"))
    pivots = pivots.select("node", "num", "tag", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    return own.unionByName(pivots).select(F.xxhash64("node", "chunk").alias("node"), "num", "tag")


def _rest(rows: DataFrame, leaf: int) -> DataFrame:
    """Long lists that one component fills but for a rest: chunks of it, each with the whole rest."""
    n = F.ceil((F.col("size") - F.col("rest")) / leaf).cast("int")
    own = F.pmod(F.xxhash64("num", "node"), n).cast("int")
    chunk = F.explode(F.when(F.col("component") == F.col("most"), F.array(own)).otherwise(F.sequence(F.lit(0), n - 1)))
    rows = rows.select("node", "num", "tag", chunk.alias("chunk"))
    return rows.select(F.xxhash64("node", "chunk").alias("node"), "num", "tag")


def _paired(rows: DataFrame, leaf: int) -> DataFrame:
    """Long lists that no further shingle parts: every pair of blocks is a list."""
    n = F.ceil(F.col("size") / max(1, leaf // 2)).cast("int")
    rows = rows.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("num", "node"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "num", "tag")


def _open(scratch: Scratch, shared: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Rows of the lists that hold several components, with the largest one and what is outside of it."""
    at = scratch.table(_with_labels(shared, labels), "labelled")
    parts = at.groupBy("node", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("all"), F.max("m").alias("m"), F.max_by("component", "m").alias("most"))
    several = parts.filter("parts > 1").select("node", "most", "all", (F.col("all") - F.col("m")).alias("rest"))
    return scratch.table(join_spread(at, scratch.table(several, "several"), "node", "all", total), "open")


def _with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``facts`` with the component of each set, itself if it has no link."""
    return facts.join(labels.select(F.col("id").alias("num"), "component"), "num", "left").withColumn("component", F.coalesce("component", "num"))


def jaccard_components(docs: DataFrame, percent: int = 80, words: int = WORDS, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text", light: int | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with
    equal sets are one class, so copies are never paired. Null ids take part but cannot
    name a component: where no id can, it is null. Rows that repeat an id are documents
    of their own. An empty table gives no rows; other columns are not read. ``light``
    sets the boundary by hand; ``percent`` is at least 76, below which small sets could
    link with fewer than DEEPEST common shingles.
    """
    if not 76 <= percent <= 100:
        raise ValueError("percent lies from 76 to 100")
    scratch = Scratch(docs.sparkSession)
    described = scratch.table(_described(docs, id_col, text_col, words), "described")
    documents = scratch.table(described.filter("slice is null").select("id", "n", "key"), "documents")
    with_set = documents.filter("key is not null")
    classes = scratch.table(with_set.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    # A row for each set. Sets of three shingles or fewer link with equal ones alone.
    steps = _summed(described.filter("slice is not null").select("slice", "counts"))
    named = classes.select(F.col("key").alias("set"), "first", "copies")
    reps = described.filter("key is not null").filter(F.col("n") >= DEEPEST).join(named.hint("merge"), (F.col("key") == F.col("set")) & F.col("id").eqNullSafe(F.col("first")))
    reps = reps.select(F.monotonically_increasing_id().alias("num"), "key", "first", "copies", "n", "packed")
    sets = scratch.table(_ordered(reps, steps, percent, words), "sets")
    scratch.drop(described)
    if light is None:
        # A row for each size up to SIZES.
        sizes = sets.groupBy(F.least("n", F.lit(SIZES)).alias("n")).agg(F.count(F.lit(1)).alias("sets"), F.sum("work").alias("work")).collect()
        light = boundary([tuple(r) for r in sizes], percent)
    rows = scratch.table(_grow(sets.select("num", "n", "prefix"), percent, light), "subsets")
    shared, total = _shared(scratch, rows)
    scratch.drop(rows)

    facts = sets.select("num", "n", "bits")
    links = labels = None
    for round_ in range(ROUNDS):
        # A dense group is joined by a few of its lists, in chunks where they are long; the others are dropped then.
        known = facts.withColumn("component", F.col("num")) if labels is None else _with_labels(facts, labels)
        lists = scratch.table(_chosen(shared if labels is None else _open(scratch, shared, labels, total), round_), "chosen")
        lists = _lists(lists.filter(F.col("size") <= leaf)).unionByName(_lists(_chunked(lists.filter(F.col("size") > leaf), leaf)))
        lists = scratch.table(_pruned(lists, known, percent, leaf), "pruned")
        found = scratch.table(_compared(lists, sets, light, percent, words), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links, scratch)
    later, rest = None, shared
    wide, half = 4 * WIDE * leaf, 2 * WIDE * leaf
    while True:
        open_ = _open(scratch, rest, labels, total)
        near = [_lists(open_.filter(F.col("size") <= wide)), _lists(_rest(open_.filter((F.col("size") > wide) & (F.col("rest") <= half)), half))]
        long = open_.filter((F.col("size") > wide) & (F.col("rest") > half))
        deepest = F.shiftright("tag", 1).bitwiseAND(7) >= DEEPEST
        near.append(_lists(_paired(long.filter(deepest), wide)))
        for x in near:
            later = x if later is None else later.unionByName(x)
        long = long.filter(~deepest)
        if long.isEmpty():
            break
        grown = long.select("node", "num", "tag").join(sets.select("num", "n", "prefix"), "num")
        rest, total = _shared(scratch, scratch.table(_grow(grown, percent), "subsets"))
    later = scratch.table(_pruned(later, _with_labels(facts, labels), percent, leaf), "pruned")
    links = links.unionByName(_compared(later, sets, light, percent, words))
    labels = components(links, scratch).withColumnRenamed("id", "num")
    labelled = sets.select("num", "key", "first").join(labels, "num")
    names = labelled.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    linked = scratch.table(join_spread(labelled, scratch.table(names, "names"), "component", "size", total).select("key", "component_id"), "linked")
    by_key = scratch.table(classes.join(linked, "key", "left").select("key", "copies", F.coalesce("component_id", "first").alias("component_id")), "named")
    keyed = join_spread(with_set.select("id", "n", "key"), by_key, "key", "copies", with_set.count())
    alone = documents.filter("key is null").select("id", "n", F.col("id").alias("component_id"))
    out = keyed.select("id", "n", "component_id").unionByName(alone)
    return scratch.result(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), "components")


def components_sql(percent: int = 80, words: int = WORDS) -> str:
    """The same over `documents`, by counting common shingles of all pairs and following links."""
    upper, lower = ("".join(map(chr, range(at, at + 26))) for at in (65, 97))
    shingle = f"list_transform(range(1, greatest(1, len(w) - {words - 1}) + 1), lambda k: array_to_string(list_slice(w, k, least(len(w), k + {words - 1})), ' '))"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct({shingle})) END AS s FROM w),
c AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT c, n, unnest(s) AS x FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m, doc_id) AS component_id FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.c = m.a"""
