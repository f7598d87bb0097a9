"""Approximate nearest neighbours by vantage-point trees, one for each shard of the rows.

Every inner node has a vantage point and, for each side, the least and the largest distance of its points from there. By the
triangle inequality no point of a side is nearer to a query than the gap between the query's distance and that range, so a
side whose gap is larger than the distance of the k-th best found cannot matter. The gap is multiplied by a factor: one gives
exact search, more leaves out sides that are unlikely to matter.

Each query is searched in the tree of one shard first; its k-th distance there bounds the search in all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storeglean.llm.common import discard, stored, table
from storeglean.llm.vectors import common_width, finite, matrix, part, parts_of, tiles

#: Rows of a shard, queries of a tile, points of a leaf.
SHARD, SLAB, LEAF = 2048, 2048, 32
NEIGHBOURS = 10
#: Pairs of queries and points whose differences a task holds at a time.
PAIRS_AT_ONCE = 1 << 15
#: What rounding may add to a gap.
SLACK = 1e-9
_INDEX = "shard int, vec_ids array<bigint>, rows array<bigint>, width int, points binary, order array<int>, nodes array<double>"
_FOUND = "query_id long, query_row long, vec_id long, row long, score double"
#: A node: start and end of its points in the order, vantage point, left and right child (-1: leaf), ranges of both sides.
_NODE = 9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Euclidean distances of all rows of two matrices, in double precision."""
    out = np.empty((len(a), len(b)))
    step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), step):
        off = a[at : at + step, None, :] - b[None]
        out[at : at + step] = np.sqrt(np.einsum("qpd,qpd->qp", off, off))
    return out


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of a tree over the rows of a matrix. The vantage point of a node is the point that is farthest from the
    mean of its points, and the median distance cuts; points that are all as far from it stay in one leaf."""
    order = np.arange(len(points), dtype=np.int32)
    nodes = [[0, len(points), 0, -1, -1, 0, 0, 0, 0]]
    waiting = [0] if len(points) else []
    while waiting:
        at = waiting.pop()
        start, end = nodes[at][:2]
        own = order[start:end]
        if len(own) <= leaf:
            continue
        vantage = own[distances(points[own].mean(0)[None], points[own])[0].argmax()]
        far = distances(points[vantage][None], points[own])[0]
        inner = far <= np.median(far)
        if inner.all():
            inner = far < far.max()
            if not inner.any():
                continue
        order[start:end] = np.concatenate((own[inner], own[~inner]))
        cut = start + int(inner.sum())
        nodes[at][2:] = [int(vantage), len(nodes), len(nodes) + 1, far[inner].min(), far[inner].max(), far[~inner].min(), far[~inner].max()]
        waiting += [len(nodes), len(nodes) + 1]
        nodes += [[start, cut, 0, -1, -1, 0, 0, 0, 0], [cut, end, 0, -1, -1, 0, 0, 0, 0]]
    return order, np.array(nodes, float)


class Search:
    """The k nearest points of a batch of queries in one tree; `seen` counts the distances that were needed."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, queries: np.ndarray, k: int, factor: float, bound: np.ndarray, own: np.ndarray):
        """bound: a distance for each query beyond which nothing counts. own: the place of a query among the points, or -1."""
        self.points, self.order, self.nodes, self.queries, self.k, self.factor, self.bound, self.own = points, order, nodes, queries, k, factor, bound, own
        self.score = np.full((len(queries), k), np.inf)
        self.place = np.full((len(queries), k), len(points))
        self.seen = 0
        self._visit(0, np.arange(len(queries)))

    def _limit(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.bound[rows], self.score[rows, -1])

    def _visit(self, node: int, rows: np.ndarray) -> None:
        start, end, vantage, left, right = self.nodes[node, :5].astype(int)
        if not len(rows) or start == end:
            return
        if left < 0:
            self._leaf(np.sort(self.order[start:end]), rows)
            return
        far = distances(self.queries[rows], self.points[vantage][None])[:, 0]
        self.seen += len(rows)
        low, high = self.nodes[node, 5::2], self.nodes[node, 6::2]
        gap = np.maximum(0, np.maximum(low[None] - far[:, None], far[:, None] - high[None])) * self.factor * (1 - SLACK)
        for side in np.argsort(gap.sum(0), kind="stable"):  # the side that is nearer to most comes first
            able = gap[:, side] <= self._limit(rows)
            self._visit((left, right)[side], rows[able])

    def _leaf(self, places: np.ndarray, rows: np.ndarray) -> None:
        found = distances(self.queries[rows], self.points[places])
        self.seen += found.size
        found[(places[None] == self.own[rows][:, None]) | (found > self.bound[rows][:, None])] = np.inf
        score = np.concatenate((self.score[rows], found), 1)
        place = np.concatenate((self.place[rows], np.broadcast_to(places, found.shape)), 1)
        place[~np.isfinite(score)] = len(self.points)
        best = np.lexsort((place, score), axis=1)[:, : self.k]
        self.score[rows], self.place[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(place, best, 1)


def _indexed(rows: pa.Table) -> pa.Table:
    """One shard's tree as one row; the points in the order in which ties are decided."""
    vec_id, row = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
    first = np.lexsort((row, vec_id))
    points = matrix(rows["x"], np.float64)[first]
    order, nodes = build(points)
    return pa.table(
        {
            "shard": pa.array([rows["shard"][0].as_py()], pa.int32()),
            "vec_ids": pa.array([vec_id[first]], pa.list_(pa.int64())),
            "rows": pa.array([row[first]], pa.list_(pa.int64())),
            "width": pa.array([points.shape[1]], pa.int32()),
            "points": pa.array([points.tobytes()], pa.binary()),
            "order": pa.array([order], pa.list_(pa.int32())),
            "nodes": pa.array([nodes.ravel()], pa.list_(pa.float64())),
        }
    )


def index(rows: DataFrame, shards: int) -> DataFrame:
    """A row with a tree for each shard. rows: vec_id, row, x, all different; a row's shard is a hash of vec_id and row."""
    return rows.withColumn("shard", part(shards, "vec_id", "row")).groupBy("shard").applyInArrow(_indexed, _INDEX)


def _searched(k: int, factor: float):
    def found(queries: pa.Table, trees: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        q_id, q_row, q_bound = (queries[c].to_numpy() for c in ("vec_id", "row", "bound"))
        for tree in trees.to_pylist() if len(q_id) else ():
            vec_id, row = (np.array(tree[c], np.int64) for c in ("vec_ids", "rows"))
            points = np.frombuffer(tree["points"], float).reshape(len(vec_id), tree["width"])
            width = max(common_width(queries["x"]), tree["width"])
            points = np.pad(points, ((0, 0), (0, width - points.shape[1])))
            own = np.searchsorted(vec_id, q_id)
            while (behind := (own < len(vec_id)) & (vec_id[np.minimum(own, len(vec_id) - 1)] == q_id) & (row[np.minimum(own, len(vec_id) - 1)] < q_row)).any():
                own[behind] += 1
            at = np.minimum(own, len(vec_id) - 1)
            own = np.where((vec_id[at] == q_id) & (row[at] == q_row), at, -1)
            order, nodes = np.array(tree["order"]), np.array(tree["nodes"]).reshape(-1, _NODE)
            search = Search(points, order, nodes, matrix(queries["x"], np.float64, width), k, factor, q_bound, own)
            i, j = np.nonzero(search.place < len(points))
            place = search.place[i, j]
            for part_, value in zip(out, (q_id[i], q_row[i], vec_id[place], row[place], search.score[i, j]), strict=True):
                part_.append(value)
        kinds = (np.int64,) * 4 + (np.float64,)
        names = ("query_id", "query_row", "vec_id", "row", "score")
        return pa.table({n: np.concatenate([np.empty(0, kind), *v]) for n, kind, v in zip(names, kinds, out, strict=True)})

    return found


def nearest(rows: DataFrame, queries: Column, k: int = NEIGHBOURS, factor: float = 1.0, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query by Euclidean distance.

    rows: vec_id, x (an array of doubles); `queries` is a condition on vec_id. With factor 1 the result is exact; with more,
    parts of a tree are left out whose distance bound times the factor is over the k-th distance found. Ties go to the smaller
    vec_id; there are fewer than k where there are no more rows. A shorter vector counts as ended by zeros. Rows with a null id,
    vector or component, non-finite components or zeros alone take no part; equal rows count once; different rows that share an
    id are rows of their own. An empty table has no result. Other columns are not read.

    A shard's tree is one row of bounded size; queries and trees meet in tiles.
    """
    if not factor >= 1:
        raise ValueError("factor: one or more")
    able = rows.where(F.col("vec_id").isNotNull() & finite("x") & F.exists("x", lambda v: v != 0))
    narrow = able.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<double>").alias("x"))
    held, path = stored(narrow.distinct().withColumn("row", F.xxhash64("x")), "vectors")
    shards = parts_of(held.count(), shard)
    trees, trees_path = stored(index(held, shards), "trees")
    asked = held.where(queries)
    slabs = parts_of(asked.count(), SLAB)
    slab, best = part(slabs, "vec_id", "row"), Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id", "row")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    search = _searched(k, factor)
    home = asked.withColumns({"shard": part(shards, "vec_id", "row"), "bound": F.lit(float("inf"))})
    near = home.groupBy("shard").cogroup(trees.groupBy("shard")).applyInArrow(search, _FOUND)
    limits = ranked(near).where(F.col("rank") == k).select("query_id", "query_row", F.col("score").alias("bound"))
    same = (F.col("vec_id") == F.col("query_id")) & (F.col("row") == F.col("query_row"))
    bounded = asked.join(limits, same, "left").select("vec_id", "row", "x", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    bounded, bounded_path = stored(bounded, "queries")
    found = tiles(bounded, slab, slabs, trees, F.col("shard"), shards).applyInArrow(search, _FOUND)
    result, _ = stored(ranked(found).select("query_id", "rank", "vec_id", "score"), "nearest")
    for used in (path, trees_path, bounded_path):
        discard(rows.sparkSession, used)
    return result


def op13_vptree(spark: SparkSession, directory: str) -> DataFrame:
    """The 10 nearest embeddings of those whose id is divisible by 100."""
    rows = table(spark, directory, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return nearest(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), d AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.x, v.x) AS score
    FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""

QUERIES = {"op13_vptree": (op13_vptree, OP13_SQL)}
