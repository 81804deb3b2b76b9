"""Exact top-k inner products by best-first search in M-trees.

The largest inner product is the nearest neighbour once every vector gets one more component that
brings it to the shard's largest norm; the query gets a zero there. Distances between such
vectors are a metric, so they can be indexed by an M-tree.

A tree holds a shard of a stated number of vectors. Its pages store, for each entry, the pivot, the covering
radius (all below is within it) and the distance to the pivot of the page's parent; leaf entries
are vectors with their distance to the page's pivot. A query takes the page with the smallest
possible distance first. Where the stored distances and the triangle inequality rule an entry out,
its own distance is never computed. The search ends when no page can hold a better vector. Bounds
are floats with a safe margin; scores are exact integers, so ties are exact too.

Trees are built in one task each and written to the shared folder; blocks of queries meet every
tree, and the best of all shards are merged per query. Neither grows with the table.

Vectors that are null or hold a null or non-finite component, and rows with a null id, take no
part. Rows with one id are candidates each, but not for a query of this id; queries with one id share
the list of the best that any of them finds. Shorter vectors end in zeros.
With fewer other vectors than k, all are returned; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.session import materialize

SHARD_ROWS = 16384
QUERY_ROWS = 2048
PAGE = 1024
FANOUT = 8


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(F.col(vector).isNotNull() & ~bad, whole)


class MTree:
    """Pages of a bulk-loaded tree over the rows of an integer matrix.

    Rows are kept in the order of the leaves, and in a leaf by their distance to its pivot, so what a
    query may need of a leaf is one stretch of rows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        self.page, self.pages = page, []
        self._place(ids, vectors)
        leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(ids)), None, leaves) if len(ids) else -1
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        self.pages = [(low, rows if low >= 0 else moved[rows], up, radius, children) for low, rows, up, radius, children in self.pages]
        self._place(ids[order], vectors[order])

    def _place(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.floats = vectors.astype(np.float64)
        norms = (self.floats**2).sum(axis=1)
        self.top = float(norms.max(initial=0.0))
        self.last = np.sqrt(np.maximum(self.top - norms, 0.0))
        self.squares = norms + self.last**2

    def _to(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        apart = ((self.floats[rows] - self.floats[pivot]) ** 2).sum(axis=1)
        return np.sqrt(apart + (self.last[rows] - self.last[pivot]) ** 2)

    def _build(self, rows: np.ndarray, parent: int | None, leaves: list[np.ndarray]) -> int:
        """Add the page over ``rows`` below the pivot ``parent``; its number.

        A page is (first row of a leaf or -1, pivots or number of rows, distances to the parent's pivot, radii, children).
        """
        to_parent = self._to(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= self.page:
            by = np.argsort(to_parent, kind="stable")
            self.pages.append((sum(map(len, leaves)), len(rows), to_parent[by], None, None))
            leaves.append(rows[by])
            return len(self.pages) - 1
        pivots = self._pivots(rows, min(FANOUT, -(-len(rows) // self.page)))
        # Products stand in for distances: all points have the same norm.
        near = (self.floats[rows] @ self.floats[pivots].T + np.outer(self.last[rows], self.last[pivots])).argmax(axis=1)
        groups = [rows[near == k] for k in range(len(pivots))]
        if max(map(len, groups)) == len(rows):
            # Equal vectors can't be told apart; they are cut in the order they have.
            groups = np.array_split(rows, min(FANOUT, -(-len(rows) // self.page)))
            pivots = [g[0] for g in groups]
        entries = [(p, g) for p, g in zip(pivots, groups) if len(g)]
        pivots = np.array([p for p, _ in entries])
        radius = np.array([self._to(g, p).max() for p, g in entries])
        children = np.array([self._build(g, p, leaves) for p, g in entries])
        up = self._to(pivots, parent) if parent is not None else np.zeros(len(pivots))
        self.pages.append((-1, pivots, up, radius, children))
        return len(self.pages) - 1

    def _pivots(self, rows: np.ndarray, count: int) -> np.ndarray:
        """Rows far from each other: always the one farthest from those chosen."""
        sample = rows[:: max(1, len(rows) // 512)]
        chosen, nearest = [sample[0]], self._to(sample, sample[0])
        while len(chosen) < max(2, count) and nearest.max() > 0:
            chosen.append(sample[nearest.argmax()])
            nearest = np.minimum(nearest, self._to(sample, chosen[-1]))
        return np.array(chosen)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """(-score, id) of the k best vectors but that with the id ``own``, and how many distances were computed."""
        best: list[tuple[int, int]] = []  # heap with the worst of the best first, as (score, -id)
        if self.root < 0:
            return [], 0
        q = query.astype(np.float64)
        square = float((q**2).sum())
        exact = math.sqrt(square * self.top) < 2**52  # sums of products are whole doubles
        margin = 1e-6 * (1.0 + math.sqrt(square + self.top))
        reach, computed = math.inf, 0
        heap = [(0.0, self.root, math.nan)]
        while heap:
            low, number, above = heapq.heappop(heap)
            if low > reach:
                break
            first, rows, up, radius, children = self.pages[number]
            bounded = above == above and reach < math.inf
            if first >= 0:
                a, b = 0, rows
                if bounded:
                    a, b = np.searchsorted(up, [above - reach, above + reach])
                    b = int(np.searchsorted(up, above + reach, "right"))
                a, b = first + int(a), first + b
                computed += b - a
                scores = self.floats[a:b] @ q if exact else self.vectors[a:b] @ query
                self._offer(best, scores, self.ids[a:b], own, k)
                if len(best) == k:
                    reach = math.sqrt(max(square + self.top - 2.0 * best[0][0], 0.0)) + margin
                continue
            if bounded:
                possible = np.abs(above - up) - radius <= reach
                rows, radius, children = rows[possible], radius[possible], children[possible]
            computed += len(rows)
            distance = np.sqrt(np.maximum(square + self.squares[rows] - 2.0 * (self.floats[rows] @ q), 0.0))
            lows = np.maximum(distance - radius - margin, 0.0)
            for low_, d, child in zip(lows.tolist(), distance.tolist(), children.tolist()):
                if low_ <= reach:
                    heapq.heappush(heap, (low_, child, d))
        return sorted((-s, -i) for s, i in best), computed

    @staticmethod
    def _offer(best: list, scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> None:
        others = ids != own
        scores, ids = scores[others], ids[others]
        least = best[0][0] if len(best) == k else -math.inf
        if len(scores) > k:
            least = max(least, np.partition(scores, -k)[-k])
        at = np.flatnonzero(scores >= least)
        for score, i in zip(scores[at].tolist(), ids[at].tolist()):
            entry = (int(score), -i)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)

    def dump(self) -> bytes:
        low, high = int(self.vectors.min(initial=0)), int(self.vectors.max(initial=0))
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        return pickle.dumps((self.ids, self.vectors.astype(kind), self.pages, self.root, self.page))

    @staticmethod
    def load(data: bytes) -> MTree:
        tree = MTree.__new__(MTree)
        ids, small, tree.pages, tree.root, tree.page = pickle.loads(data)
        tree._place(ids, small.astype(np.int64))
        return tree


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, ended by zeros."""
    out = np.zeros((len(lists), width), np.int64)
    counts = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(lists)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[row, at] = lists.flatten().to_numpy()
    return out


def build_trees(vectors: DataFrame, width: int, shards: int, page: int) -> DataFrame:
    """(shard, tree): a tree of every shard of vectors (id, v)."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        lists = table.column("v").combine_chunks()
        tree = MTree(table.column("id").to_numpy(), matrix(lists, width), page)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "tree": pa.array([tree.dump()], pa.binary())})

    # Dealt by row, so an id that very many rows share is in all shards.
    sharded = vectors.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    return materialize(sharded.groupBy("shard").applyInArrow(build, "shard int, tree binary"))


def top_inner_products(
    table: DataFrame,
    queries: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    page: int = PAGE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each row that ``queries`` holds for.

    ``queries`` is a condition on the column ``id``. Components become floor(scale * x).
    """
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("x"))
    rows = rows.select("id", quantised("x", scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = materialize(rows)
    asked = rows.where(queries)
    total, width, many = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(queries, 1))).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-many // query_rows))
    trees = build_trees(rows, width or 0, shards, page)
    # Every block of queries meets every tree: as many rows as trees times blocks on either side.
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree_data, block in zip(batch.column(0), batch.column(1)):
                tree, out = MTree.load(tree_data.as_py()), []
                own = block.values.field("id").to_pylist()
                vectors = matrix(block.values.field("v"), width)
                for i, q in zip(own, vectors):
                    out += [(i, j, -s) for s, j in tree.search(q, i, k)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    pairs = trees.join(asked, ["shard", "block"]).select("tree", "asked").repartition(max(1, shards * blocks))
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
