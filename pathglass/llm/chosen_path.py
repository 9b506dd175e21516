"""Near-duplicate documents by the Chosen Path set similarity join (operator 10).

Documents become sets of hashed word shingles and short minwise signatures. Trees
branch the documents by the minwise token at chosen signature places: documents
with the same token go to the same child. Small nodes are compared exhaustively;
larger ones by bitmaps first, and the largest branch on, along several more places at each level, so that a similar
pair all but surely stays together on some path. A group so dense that
branching cannot part it is linked by chunks in the first trees; all trees then
grow on, but leave out what lies within one component. Independent trees repeat
this until a pair at the threshold is missed with a chance of (1 - s) ** trees.

Links are confirmed on full sets. A node yields a spanning forest of its links,
not all pairs, and components are joined by label propagation on tables.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from itertools import pairwise, tee

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.llm.bitmaps import WIDE, bitmap, candidate_groups, in_blocks
from pathglass.llm.common import HOT_KEYS, Scratch, join_spread, task_tables, text_stream

WORDS = 5
TREES = 10
#: Trees whose links settle components before the others are grown.
FIRST_TREES = 2
#: Nodes of at most so many documents are compared exhaustively; once components are known, of
#: WIDE times as many by bitmaps, as each level costs a document BRANCHES rows.
LEAF = 1_000
#: Levels of a tree; nodes that are still larger are compared block by block.
LEVELS = 4
#: Places branched along at each level below the root: at 0.75 a pair stays together
#: with 1 - 0.25 ** 6 at each, so that even three levels cost a tree less than 0.1 %.
BRANCHES = 6
#: Signature places: the trees' choices, and the estimate that spares exact comparisons.
PLACES = 64
#: Pairs are compared exactly if their estimated similarity is at most this far below
#: the threshold: under 25 of 64 equal places at 0.75, whose chance (about 1e-10) is
#: far below that of the trees' misses; no tree recovers it.
SLACK = 0.36
#: Groups of nodes in each shuffle partition.
NODE_GROUPS = 16
#: Bytes of text whose words are hashed at a time; longer words are hashed one by one.
SLICE, LONG_WORD = 1 << 20, 512

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_DRAWN = np.random.Generator(np.random.PCG64(10)).integers(0, 1 << 32, (2, PLACES), np.uint32)
_FACTORS, _TERMS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


#: Odd factors of the words of a shingle.
_ODD = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Bytes between words, letters as they count, and the first bytes of eight.
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of lower-cased bytes, and where it starts. Words end at blanks; ``data`` ends with one."""
    edges = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    starts, n = edges[::2], edges[1::2] - edges[::2]
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,))
    h = n.astype(np.uint64) * _M1
    left = np.arange(len(n))
    for k in range(0, LONG_WORD, 8):  # eight bytes of all words that have as many
        if k:
            left = left[n[left] > k]
        if not len(left):
            break
        h[left] = _mix(h[left] * _M2 ^ (eight[starts[left] + k].astype(np.uint64) & _FIRST[np.minimum(n[left] - k, 8)]))
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(padded[starts[k] : starts[k] + n[k]].tobytes())
    return h, starts


def shingle_sets(texts: Iterable[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct hashed shingles of each text, ascending; with fewer words the whole sequence as one.

    Texts are looked at about SLICE bytes at a time, as arrays over all their words.
    """
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield from _sets(held, words)
            held, size = [], 0
    if held:
        yield from _sets(held, words)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    w, starts = _words(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))
    first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))
    n = np.diff(first)
    found = {size: _shingled(w, size) for size in {*np.minimum(n, words).tolist()} - {0}}
    for a, size in zip(first.tolist(), n.tolist(), strict=False):
        h = np.sort(found[min(size, words)][a : a + max(1, size - words + 1)]) if size else w[:0]
        yield h[np.append(True, h[1:] != h[:-1])] if size else h


def _shingled(w: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words that follow each other."""
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h += w[k : k + len(h)] * _ODD[k % len(_ODD)] + np.uint64(k // len(_ODD))
    return _mix(h)


def signature(found: np.ndarray) -> np.ndarray:
    """A 32-bit minwise token for each place.

    A token is a hash of the whole element that is smallest there: smallest values
    are small numbers, so that cut to 32 bits they would agree by chance all the
    more often, the more sets there are.
    """
    at, least = np.empty(PLACES, np.int64), (found >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 18) // max(1, len(found)))
    for k in range(0, PLACES, step):
        at[k : k + step] = (least[None, :] * _FACTORS[k : k + step, None] + _TERMS[k : k + step, None]).argmin(1)
    return (_mix(found[at]) >> np.uint64(32)).astype(np.uint32)


def _describe(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_hash, n_shingles, key, sig, packed, bits): key names the set, packed is the compressed text."""

    def run(batches):
        with task_tables("shingles"):
            zip_ = zstandard.ZstdCompressor(level=1)
            for b in batches:
                n, key, sig, packed, bits = [], [], [], [], []
                texts, again = tee(x.encode() for x in text_stream(b, "__text"))
                for text, found in zip(again, shingle_sets(texts, words), strict=True):
                    n.append(len(found))
                    key.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sig.append(signature(found).tobytes() if len(found) else None)
                    packed.append(zip_.compress(text) if len(found) else None)
                    bits.append(bitmap(found) if len(found) else None)
                columns = [pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (key, sig, packed, bits))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), *columns], ["id", "text_hash", "n_shingles", "key", "sig", "packed", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "id long, text_hash long, n_shingles long, key binary, sig binary, packed binary, bits binary")


def places_below(node: int, level: int, free: list[int]) -> list[int]:
    """Distinct places to branch a node along, of those that are no tree's root."""
    return random.Random(xxhash.xxh3_64_intdigest(f"{node}:{level}")).sample(free, min(BRANCHES, len(free)))


def _branch(rows: DataFrame, level: int, roots: list[int] | None = None, free: list[int] | None = None, seen: tuple[int, ...] = ()) -> DataFrame:
    """(node, key, seen) one level below rows of (node, key, sig): a place for each tree
    at the root, BRANCHES chosen for each node below. Nodes at ``seen`` places are marked."""
    def run(batches):
        for b in batches:
            nodes, at, known = [], [], []
            for k, (node, s) in enumerate(zip(b.column("node").to_pylist(), b.column("sig").to_pylist(), strict=True)):
                tokens = np.frombuffer(s, np.uint32)
                for place in roots or places_below(node, level, free):
                    nodes.append(xxhash.xxh3_64_intdigest(f"{node}:{place}:{tokens[place]}") - (1 << 63))
                    at.append(k)
                    known.append(place in seen)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), b.column("key").take(pa.array(at, pa.int32())), pa.array(known, pa.bool_())], ["node", "key", "seen"])

    return rows.select("node", "key", "sig").mapInArrow(run, "node long, key binary, seen boolean").distinct()


def _chunks(large: DataFrame, leaf: int) -> DataFrame:
    """Large nodes in chunks, each with the node's smallest set: a first, linear look at them."""
    node = F.xxhash64("node", "chunk")
    n = F.ceil(F.col("size") / leaf).cast("int")
    rows = large.select("node", "key", F.pmod(F.xxhash64("key", "node"), n).cast("int").alias("chunk"))
    pivots = large.groupBy("node").agg(F.min("key").alias("key"), F.max(n).alias("n")).select("node", "key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    return rows.unionByName(pivots).select(node.alias("node"), "key").distinct()


def _rest_against_all(large: DataFrame, leaf: int) -> DataFrame:
    """Nodes that one component fills but for a rest: chunks of it, each with the whole rest."""
    most = F.col("c").eqNullSafe(F.col("most"))
    n = F.ceil((F.col("size") - F.col("rest")) / leaf).cast("int")
    own = F.pmod(F.xxhash64("key", "node"), n).cast("int")
    chunk = F.explode(F.when(most, F.array(own)).otherwise(F.sequence(F.lit(0), n - 1)))
    rows = large.select("node", "key", chunk.alias("chunk"))
    return rows.select(F.xxhash64("node", "chunk").alias("node"), "key")


def _blocks(large: DataFrame, leaf: int) -> DataFrame:
    """Members of nodes that no level made small: every pair of blocks becomes a node of its own."""
    n = F.ceil(F.col("size") / max(1, leaf // 2)).cast("int")
    rows = large.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("key", "node"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    node = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(node.alias("node"), "key")


def _leaves(scratch: Scratch, reps: DataFrame, roots: list[int], leaf: int, levels: int, labels: DataFrame | None = None, free: list[int] | None = None, seen: tuple[int, ...] = ()) -> DataFrame:
    """(node, members): sets to compare exhaustively; equal member lists once.

    Without ``labels`` (the first trees) large nodes are only looked at in chunks,
    which is enough to join a dense group. With the components (id, component) that
    this has shown, nodes within one component are finished; large ones that one
    component nearly fills compare the rest with everything, others branch on
    along ``free`` places. Small roots at places ``seen`` before are left out.
    """
    level = _branch(reps.withColumn("node", F.lit(0).cast("long")), 0, roots, seen=seen)
    wide = leaf if labels is None else WIDE * leaf
    lists = lambda rows: rows.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("members")).select("members")
    out = None
    for depth in range(1, levels + 1):
        # Counts combine before the shuffle. Most nodes hold one set and go here.
        level = scratch.table(level, "tree-level")
        rows = level.count()
        counts = scratch.table(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "tree-counts")
        shared = join_spread(level, counts, "node", "size", rows)
        if labels is not None:
            at = shared.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
            at = at.select("node", "key", "seen", "size", "c")
            at = scratch.table(at, "tree-at")
            parts = at.groupBy("node", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("all"), F.max("m").alias("m"), F.max_by("c", "m").alias("most"))
            open_ = parts.filter("parts > 1").select("node", "most", "all", (F.col("all") - F.col("m")).alias("rest"))
            shared = join_spread(at, scratch.table(open_, "tree-open"), "node", "all", rows).drop("all")
        shared = scratch.table(shared, "tree-shared")
        small, large = shared.filter((F.col("size") <= wide) & ~(F.col("seen") & (F.col("size") <= leaf))), shared.filter(F.col("size") > wide)
        out = lists(small) if out is None else out.unionByName(lists(small))
        if large.isEmpty():
            break
        if labels is None:
            out = out.unionByName(lists(_chunks(large, leaf)))
            break
        out = out.unionByName(lists(_rest_against_all(large.filter(F.col("rest") <= wide // 2), max(1, wide // 2))))
        large = large.filter(F.col("rest") > wide // 2)
        if depth == levels:
            out = out.unionByName(lists(_blocks(large, wide)))
        else:
            level = _branch(large.join(reps.select("key", "sig"), "key"), depth, free=free)
    return _once(out)


def link_node(keys: list, sets: list[np.ndarray], sigs: np.ndarray, percent: int) -> list[tuple]:
    """A spanning forest of the links between the documents of a node, as (smaller key, larger key)."""
    n, parent, out = len(keys), list(range(len(keys))), []

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    size = np.fromiter(map(len, sets), np.int64, n)
    least = (percent / 100 - SLACK) * sigs.shape[1]
    for i in range(1, n):
        same = (sigs[:i] == sigs[i]).sum(1)
        # Sets whose sizes differ too much cannot be similar enough.
        fits = (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i])) & (same >= least)
        near = np.flatnonzero(fits)
        for j in near[np.argsort(-same[near], kind="stable")].tolist():
            a, b = root(j), root(i)
            if a == b:
                continue
            common = len(np.intersect1d(sets[j], sets[i], assume_unique=True))
            if 100 * common >= percent * (size[j] + size[i] - common):
                parent[max(a, b)] = min(a, b)
                out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return out


def _pruned(leaves: DataFrame, facts: DataFrame, percent: int, leaf: int) -> DataFrame:
    """What is left of (node, members) by ``facts`` (key, n, bits, component): groups of members that may link over components."""
    rows = facts.join(leaves.select("node", F.explode("members").alias("key")).hint("merge"), "key")

    def run(table: pa.Table) -> pa.Table:
        found = []
        for node in _nodes(table):
            keys = node.column("key").to_pylist()
            order = sorted(range(len(keys)), key=keys.__getitem__)
            bits = np.frombuffer(b"".join(node.column("bits").to_pylist()), np.uint64).reshape(len(keys), -1)[order]
            component = np.unique(np.array(node.column("component").to_pylist(), object), return_inverse=True)[1][order]
            groups = candidate_groups(node.column("n").to_numpy()[order], bits, component, percent)
            found += [[keys[order[k]] for k in part.tolist()] for g in groups for part in in_blocks(g, leaf)]
        return pa.table({"members": pa.array(found, pa.list_(pa.binary()))})

    return _once(_dealt(rows).applyInArrow(run, "members array<binary>"))


def _dealt(rows: DataFrame):
    """Rows grouped so that many small nodes share a call; no node is parted."""
    parts = NODE_GROUPS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part"))


def _nodes(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each node of a group."""
    table = table.sort_by("node")
    node = table.column("node").combine_chunks()
    cuts = np.flatnonzero(pc.not_equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)) + 1
    for a, b in pairwise([0, *cuts.tolist(), len(node)]):
        yield table.slice(a, b - a)


def _once(lists: DataFrame) -> DataFrame:
    """(node, members): equal lists once."""
    node = F.sha2(F.array_join(F.transform("members", F.hex), ""), 256)
    return lists.filter(F.size("members") > 1).groupBy(node.alias("node")).agg(F.first("members").alias("members"))


def _links(leaves: DataFrame, reps: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b): confirmed links that connect all linked sets of each leaf."""
    # What fetches texts shuffles at every size.
    rows = reps.select("key", "packed").join(leaves.select("node", F.explode("members").alias("key")).hint("merge"), "key").select("node", "key", "packed")

    def run(table: pa.Table) -> pa.Table:
        unzip, found = zstandard.ZstdDecompressor(), []
        for node in _nodes(table):
            packed = dict(zip(node.column("key").to_pylist(), node.column("packed").to_pylist(), strict=True))
            keys = sorted(packed)
            sets = list(shingle_sets((unzip.decompress(packed[k]) for k in keys), words))
            found += link_node(keys, sets, np.stack([signature(x) for x in sets]), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return _dealt(rows).applyInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component): the smallest end of any link that is reachable from each, for links (a, b).

    Each round sends every end the smallest label next to it and then jumps to the
    label's own label; rounds are written to the shared folder. They go on until no
    label changes, however many that takes.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    total = edges.count()
    labels = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("ends"))
    labels = scratch.table(labels.select(F.col("a").alias("id"), "ends", F.least("a", "m").alias("component")), "labels")
    while total <= HOT_KEYS:  # as many rows as a broadcast may have: no task is too much
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        joined = labels.join(near, "id").select("id", "ends", F.col("component").alias("before"), F.least("component", "m").alias("component"))
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = scratch.table(joined.join(own, "component").select("id", "ends", "before", F.least("component", "further").alias("component")), "labels")
        labels = new.select("id", "ends", "component")
        if new.filter("before != component").isEmpty():
            return labels.select("id", "component")
    while True:
        # Neither an end of very many links nor a label of very many ends meets in one task.
        near = join_spread(edges, labels.withColumnRenamed("id", "b"), "b", "ends", total).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        joined = labels.join(near, "id").select("id", "ends", F.col("component").alias("before"), F.least("component", "m").alias("component"))
        joined = scratch.table(joined, "labels-near")
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        hops = joined.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(own, "component").filter("further < component")
        further = join_spread(joined, scratch.table(hops, "hops"), "component", "size", total, "left")
        new = scratch.table(further.select("id", "ends", "before", F.coalesce("further", "component").alias("component")), "labels")
        labels = new.select("id", "ends", "component")
        if new.filter("before != component").isEmpty():
            return labels.select("id", "component")


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS, trees: int = TREES, leaf: int = LEAF, levels: int = LEVELS, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row, and xxhash64 of its text with ``text_hash``.

    Null, empty and blank texts have no shingles and stand alone. Rows with equal
    sets are one class from the start, so copies are never paired. Null ids take
    part, but cannot name a component: where no id can, the component is null and
    every row of it is kept. Rows that repeat an id are documents of their own.
    An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    described = scratch.table(_describe(docs, id_col, text_col, words), "shingled")
    rows = scratch.table(described.select("id", "text_hash", "n_shingles", "key"), "rows")
    with_set = rows.filter(F.col("key").isNotNull())
    classes = scratch.table(with_set.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "set-classes")
    # A row for each set, but for rows that repeat an id with its set. The id is part
    # of the join, so the copies of a set do not meet in one task.
    first = classes.select(F.col("key").alias("set"), "first").hint("merge")
    reps = described.join(first, (F.col("key") == F.col("set")) & F.col("id").eqNullSafe(F.col("first"))).select("key", "sig", "packed", "n_shingles", "bits")
    reps = scratch.table(reps, "sets")
    scratch.drop(described)
    facts = reps.select("key", F.col("n_shingles").alias("n"), "bits")
    places = [k * PLACES // trees for k in range(trees)]
    # The first trees find most components; the others skip what these have settled.
    leaves = _leaves(scratch, reps, places[:FIRST_TREES], leaf, levels)
    leaves = scratch.table(_pruned(leaves, facts.withColumn("component", F.col("key")), percent, leaf), "leaves")
    early = scratch.table(_links(leaves, reps, percent, words), "links")
    # The first ones grow on below roots that were only looked at in chunks.
    settled = components(early, scratch)
    free = [k for k in range(PLACES) if k not in places] or places
    grown = _leaves(scratch, reps, places, leaf, levels, settled, free, seen=tuple(places[:FIRST_TREES]))
    own = facts.join(settled.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    late = _links(scratch.table(_pruned(grown, own, percent, leaf), "leaves"), reps, percent, words)
    labels = components(early.unionByName(late), scratch).withColumnRenamed("id", "key")
    labelled = classes.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_key = scratch.table(labelled.join(names, "component").select("key", "copies", "component_id"), "named")
    keyed = join_spread(with_set.select("id", "text_hash", "n_shingles", "key"), by_key, "key", "copies", with_set.count())
    out = keyed.select("id", "text_hash", "n_shingles", "component_id").unionByName(rows.filter("key is null").select("id", "text_hash", "n_shingles", F.col("id").alias("component_id")))
    component = F.col("component_id")
    out = out.select(F.col("id").alias(id_col), "n_shingles", component, F.coalesce(component == F.col("id"), component.isNull()).alias("kept"), *(["text_hash"] if text_hash else []))
    return scratch.result(out, "components")
