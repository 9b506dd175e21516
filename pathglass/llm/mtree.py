"""Exact top-k search by inner product with M-trees (operator 1).

Vectors become integers, floor(256 * x). Appending sqrt(M - |x|^2), M the largest
squared norm, to a row and 0 to a query makes the squared distance M + |q|^2 - 2 q.x,
so the nearest rows in this metric space have the largest inner products.

Equal vectors have equal scores, so a query vector is searched once and of each
vector only the smallest ids are candidates. Rows are dealt to the root's routing
objects, a sample that grows with the rows up to a bound, so that a cell is about a
block; larger cells have several. A block is an M-tree of paged nodes with routing
object, covering radius and distance to the parent's. A query searches its own cell
first; the last score found there bounds the search, so that only cells whose ball
may hold a better row are searched next, again best first with the bound. A node's
stored parent distance often rules it out by the triangle inequality before its own
distance is computed. Bounds are widened by a small slack for rounding; scores are
exact integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathglass.llm.common import join_spread, materialise

#: Routing objects of the root: at least so many (if there are as many rows), one for
#: BLOCK rows, at most ROOT_MOST and what ROOT_BYTES hold.
ROOT, ROOT_MOST, ROOT_BYTES = 64, 65_536, 64 << 20
#: Rows of a block, on average; larger cells have several. Also the queries that a
#: task searches a block for.
BLOCK = 8_192
#: Further cells that a query looks into in the first round, and the growth of the next rounds.
CELLS_FIRST, CELLS_MORE = 16, 8
#: Entries of a leaf page and of an inner node.
PAGE, FANOUT = 128, 16

SCALE = 256


#: Squared norms stay below this, so that every score fits a signed 64-bit integer.
NORM_LIMIT = 1 << 62


def quantised(values) -> np.ndarray | None:
    """floor(256 * x) of each component; None for an empty vector, one with a null or
    non-finite component, or one so long that scores could leave 64 bits."""
    x = np.asarray(values, np.float64)  # a null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * SCALE)
        return x.astype(np.int64) if len(x) and float(x @ x) < NORM_LIMIT else None


def _load(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, norm, n): usable vectors as packed 64-bit integers, with squared norm and length."""

    def run(batches):
        for b in batches:
            lists = b.column("v")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ids, packed, norms, sizes = [], [], [], []
            for k, (key, there) in enumerate(zip(b.column("id").to_pylist(), lists.is_valid().to_pylist(), strict=True)):
                x = quantised(values[offsets[k] : offsets[k + 1]]) if there else None
                if x is not None:
                    ids.append(key)
                    packed.append(x.tobytes())
                    norms.append(int(x @ x))
                    sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.int64()), pa.array(sizes, pa.int32())], ["id", "v", "norm", "n"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id is not null")
    return rows.mapInArrow(run, "id long, v binary, norm long, n int")


class Space:
    """The metric space: rows lifted by one coordinate, queries with 0 there."""

    def __init__(self, top: int):
        self.top = top  # the largest squared norm of a row

    def rows(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.top - (x * x).sum(1)).astype(np.float64))
        return np.concatenate([x.astype(np.float64), lift[:, None]], 1)

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.append(x.astype(np.float64), 0.0)

    def radius(self, q: np.ndarray, score: int | None) -> float:
        """Rows with at least this score lie within this distance of the query."""
        if score is None:
            return np.inf
        most = self.top + float(q @ q)
        # Rounding errs by a small part of the largest numbers involved.
        return float(np.sqrt(max(0.0, most - 2.0 * score) + 1e-14 * most)) * (1 + 1e-9) + 1e-6 + 1e-12 * float(np.sqrt(most))


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(1))


class MTree:
    """Nodes in arrays: routing object, covering radius, distance to the parent's routing object."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, space: Space):
        self.x, self.ids, self.space = vectors, ids, space
        self.points = space.rows(vectors)
        self.computed = 0  # distances to queries
        self.repeats = len(np.unique(ids)) < len(ids)
        self.routes, self.radii, self.to_parent, self.children, self.pages = [], [], [], [], []
        self.root = self._build(np.arange(len(ids)), None)
        self.routes, self.radii, self.to_parent = np.array(self.routes), np.array(self.radii), np.array(self.to_parent)

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        points = self.points[rows]
        centre = points.mean(0)
        route = points[np.argmin(_distances(points, centre))]
        node, apart = len(self.routes), _distances(points, route)
        self.routes.append(route)
        self.radii.append(float(apart.max()))
        self.to_parent.append(0.0 if parent is None else float(np.sqrt(((route - parent) ** 2).sum())))
        self.children.append([])
        self.pages.append(None)
        if len(rows) <= PAGE or self.radii[node] == 0.0:
            near = np.argsort(apart, kind="stable")
            self.pages[node] = (rows[near], apart[near])
            return node
        # Split by the nearest of some rows that lie far from each other.
        chosen = [int(np.argmax(apart))]
        least = _distances(points, points[chosen[0]])
        while len(chosen) < min(FANOUT, -(-len(rows) // PAGE) + 1) and least.max() > 0:
            chosen.append(int(np.argmax(least)))
            least = np.minimum(least, _distances(points, points[chosen[-1]]))
        at = np.argmin(np.stack([_distances(points, points[c]) for c in chosen]), 0)
        parts = [rows[at == k] for k in range(len(chosen))]
        for part in parts:
            if len(part):
                child = self._build(part, route)
                self.children[node].append(child)
        self.children[node] = np.array(self.children[node])
        return node

    def search(self, q: np.ndarray, k: int, floor: int | None, each: int | None = None) -> list[tuple[int, int]]:
        """The best (score, id) in the tree: at most k, highest first, ties to smaller ids.

        Rows under ``floor`` (k rows elsewhere reach it) may be left out. At most ``each``
        rows of one id are taken, its best.
        """
        each = k if each is None or not self.repeats else each
        point, best = self.space.query(q), []  # a heap with the worst on top: (score, -id)
        radius = self.space.radius(point, floor)
        d = float(np.sqrt(((self.routes[self.root] - point) ** 2).sum()))
        queue = [(max(0.0, d - self.radii[self.root]), self.root, d)]
        while queue:
            low, node, d = heapq.heappop(queue)
            if low > radius:
                break
            page = self.pages[node]
            if page is None:
                kids = self.children[node]
                # |d - d(parent, child)| - radius bounds the child before its distance is known.
                kids = kids[np.abs(d - self.to_parent[kids]) - self.radii[kids] <= radius]
                apart = _distances(self.routes[kids], point)
                self.computed += len(kids)
                for kid, to, bound in zip(kids.tolist(), apart.tolist(), np.maximum(0.0, apart - self.radii[kids]).tolist(), strict=True):
                    if bound <= radius:
                        heapq.heappush(queue, (bound, kid, to))
                continue
            rows, apart = page
            a, b = np.searchsorted(apart, d - radius), np.searchsorted(apart, d + radius, "right")
            rows = rows[a:b]
            scores, ids = self.x[rows] @ q, self.ids[rows]
            self.computed += len(rows)
            if len(best) == k:
                better = scores >= best[0][0]
                scores, ids = scores[better], ids[better]
            # Only the k best of the page can enter, unless ids repeat.
            order = np.lexsort((ids, -scores))[: k if each == k else None]
            for s, i in zip(scores[order].tolist(), ids[order].tolist(), strict=True):
                if len(best) == k and s < best[0][0]:
                    break
                if each < k and len(own := [b for b in best if b[1] == -i]) >= each:
                    if (s, -i) > min(own):
                        best.remove(min(own))
                        best.append((s, -i))
                        heapq.heapify(best)
                elif len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                radius = min(radius, self.space.radius(point, best[0][0]))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _stack(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, n)


class Root:
    """The root's routing objects, by vector length, in groups around some of them.

    A row goes to the nearest routing object of the nearest group, so that dealing
    costs about the square root of their number. Vectors of a length that the sample
    lacks have a cell of their own, -length, without a routing object.
    """

    def __init__(self, sample: list[np.ndarray], space: Space):
        self.space, self.routes, self.groups = space, {}, {}
        number = 0
        for n in sorted({len(x) for x in sample}):
            at = space.rows(np.unique(np.stack([x for x in sample if len(x) == n]), axis=0))
            centres = at[:: max(1, int(len(at) ** 0.5))]
            own = np.argmin(np.stack([_distances(at, c) for c in centres]), 0)
            self.routes[n] = (number, at)
            self.groups[n] = (centres, [np.flatnonzero(own == k) for k in range(len(centres))])
            number += len(at)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distance from the routing object."""
        n = x.shape[1]
        if n not in self.routes:
            return np.full(len(x), -n), np.zeros(len(x))
        number, at = self.routes[n]
        centres, groups = self.groups[n]
        points = self.space.rows(x)
        group = np.argmin(np.stack([_distances(points, c) for c in centres]), 0)
        cell, apart = np.empty(len(x), np.int64), np.empty(len(x))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            far = np.stack([_distances(points[rows], at[k]) for k in groups[g]])
            near = np.argmin(far, 0)
            cell[rows], apart[rows] = number + groups[g][near], far[near, np.arange(len(rows))]
        return cell, apart


def _stack(packed: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int64).reshape(-1, n)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, root: int = ROOT, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k best other rows.

    Vectors that are null, empty or hold a null or non-finite component take no
    part, nor do rows with a null id, nor vectors so long (squared norm from 2**62)
    that a score could leave 64 bits. Vectors are only compared with those of their
    own length. Rows that repeat an id are no candidates for each other; as
    candidates of others each counts, and as queries they have a list for each
    distinct vector, of which the k best are given. A query without candidates gives
    no rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = materialise(_load(vectors, id_col, vec_col), "vectors")
    total, top, longest = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(top)
    wanted = min(max(root, total // block), ROOT_MOST, max(root, ROOT_BYTES // (8 * longest)))
    # Routing objects: rows with the smallest hashes, a bounded number.
    sample = [np.frombuffer(r["v"], np.int64) for r in rows.orderBy(F.xxhash64("v"), "id").select("v").limit(wanted).collect()]
    tops = Root(sample, space)

    # Of equal vectors the smallest ids, k for each that a query may have itself, say all.
    of_id = Window.partitionBy("v", "id").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(of_id)).filter(F.col("r") <= k)
    few = few.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)

    def cell_of(batches):
        for b in batches:
            packed, n = b.column("v").to_pylist(), b.column("n").to_numpy()
            cell, apart = np.zeros(len(n), np.int64), np.zeros(len(n))
            for size in np.unique(n).tolist():
                at = np.flatnonzero(n == size)
                cell[at], apart[at] = tops.cells(_stack([packed[i] for i in at], size))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell), pa.array(apart)], ["id", "v", "cell", "apart"])

    dealt = materialise(few.select("id", "v", "n").mapInArrow(cell_of, "id long, v binary, cell long, apart double"), "cells")
    cells = dealt.groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("rows"))
    cells = materialise(cells.withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")), "cell-sizes")
    blocked = join_spread(dealt, cells, "cell", "rows", total).withColumn("block", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int"))
    radii = {r["cell"]: r["radius"] for r in cells.filter("cell >= 0").collect()}  # one for each routing object

    asked = rows.filter(F.col("id") % every == 0).select("id", "v", "n").distinct()
    queries = materialise(asked.groupBy("v").agg(F.count(F.lit(1)).alias("asked"), F.first("n").alias("n"), F.min("id").alias("id")).mapInArrow(lambda x: _with_cell(x, tops), "v binary, asked long, n int, cell long"), "queries")
    # Of one id at most k rows are kept, so that k others are left whichever id asks.
    most = 2 * k

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = []
        if left.num_rows and right.num_rows:
            packed = left.column("v").to_pylist()
            tree = MTree(_stack(packed, len(packed[0]) // 8), left.column("id").to_numpy(), space)
            for v, floor in zip(right.column("v").to_pylist(), right.column("floor").to_pylist(), strict=True):
                out += [(v, i, s) for s, i in tree.search(np.frombuffer(v, np.int64), most, floor, k)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("v", "vec_id", "score"), columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)})

    def searched(targets: DataFrame) -> DataFrame:
        """Written targets (v, cell, floor) against every block of their cell, a bounded number of both in a group."""
        sizes = targets.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(cells.select("cell", "blocks", "rows"), "cell")
        sizes = materialise(sizes.withColumn("parts", F.ceil(F.col("asked") / block).cast("int")), "target-sizes")
        trees = join_spread(blocked.select("id", "v", "cell", "block"), sizes.select("cell", "parts", "rows"), "cell", "rows", total)
        trees = trees.select("id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        ask = join_spread(targets, sizes.select("cell", "blocks", "parts", "asked"), "cell", "asked", total)
        ask = ask.select("v", "floor", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"))
        keys = ("cell", "block", "part")
        return trees.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(search, "v binary, vec_id long, score long")

    best = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    of_id_best = Window.partitionBy("v", "vec_id").orderBy(F.desc("score"))

    def kept(found: DataFrame) -> DataFrame:
        """(v, vec_id, score, r): the best rows found so far, numbered."""
        own = found.select("v", "vec_id", "score", F.row_number().over(of_id_best).alias("r")).filter(F.col("r") <= k)
        return materialise(own.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most), "near")

    def further(done: int, width: int):
        """The next cells of each query whose ball reaches into the query's, nearest first."""

        def run(batches):
            for b in batches:
                take, cell = [], []
                for i, (v, home, floor) in enumerate(zip(*(b.column(c).to_pylist() for c in ("v", "home", "floor")), strict=True)):
                    q = np.frombuffer(v, np.int64)
                    if len(q) not in tops.routes:
                        continue
                    number, at = tops.routes[len(q)]
                    reach = np.array([radii.get(c, -np.inf) for c in range(number, number + len(at))])
                    reach[home - number : home - number + 1] = -np.inf
                    point = space.query(q)
                    low = _distances(at, point) - reach
                    order = np.argsort(low, kind="stable")[done : done + width]
                    for c in (number + order[low[order] <= space.radius(point, floor)]).tolist():
                        if c in radii:
                            take.append(i)
                            cell.append(c)
                take = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("v").take(take), pa.array(cell, pa.int64()), b.column("floor").take(take)], ["v", "cell", "floor"])

        return run

    first = queries.select("v", "cell", F.lit(None).cast("long").alias("floor"))
    found = kept(searched(materialise(first, "targets")))
    # Nearest cells first, more of them each round, under the bound that the last one left.
    done, width = 0, CELLS_FIRST
    while True:
        floors = found.filter(F.col("r") == most).select("v", F.col("score").alias("floor"))
        bounded = queries.select("v", F.col("cell").alias("home")).join(floors, "v", "left")
        targets = materialise(bounded.mapInArrow(further(done, width), "v binary, cell long, floor long"), "targets")
        if targets.isEmpty():
            break
        found = kept(found.select("v", "vec_id", "score").unionByName(searched(targets)))
        done, width = done + width, width * CELLS_MORE
    found = materialise(found.groupBy("v").agg(F.collect_list(F.struct("vec_id", "score")).alias("found")).join(queries.select("v", "asked"), "v"), "found")
    lists = join_spread(asked.select(F.col("id").alias("query_id"), "v"), found, "v", "asked", total)
    pairs = lists.select("query_id", F.explode("found").alias("f")).select("query_id", "f.*").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_cell(batches, tops: Root):
    for b in batches:
        packed = b.column("v").to_pylist()
        cell = [int(tops.cells(np.frombuffer(v, np.int64)[None, :])[0][0]) for v in packed]
        yield pa.RecordBatch.from_arrays([b.column("v"), b.column("asked"), b.column("n"), pa.array(cell, pa.int64())], ["v", "asked", "n", "cell"])
