"""Exact top-k search by integer inner product, with a KD-tree per shard.

Vectors stay where they lie: a task cuts its rows into shards of `shard_rows`, whose trees split at medians of
the widest dimension and keep tight bounding boxes.  The largest inner product that a box allows bounds its
points; each query visits the boxes best first, all queries of a block in step, until no box can reach its kth
score.  That score goes along from shard to shard, so later ones are pruned from the start.

Queries are the rows that the caller names.  They go to the tasks in blocks of at most `block_bytes`, one pass
over the vectors for each; a task puts out each query's k best of all its shards, and only these are shuffled.

Cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
only vectors of one length are compared; every row but the query's own is a candidate, so rows that repeat an
id, or id and vector, find each other and are found as often as they stand there; of equal vectors in a shard
only the k + 1 smallest ids can be among anyone's best and are kept; scores of 2^62 and more raise an error;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch_path, written

LEAF = 128
_NONE = -(1 << 62)
_FAR = (1 << 63) - 1


def quantized(table: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and q (whole numbers floor(scale * x)) of every row that takes part."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
    )
    q = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return table.filter(usable).select("vec_id", q.alias("q"))


def _by_length(ids: np.ndarray, uids: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, uids, vectors) of the rows of each vector length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dims)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield dims, ids[at], uids[at], flat.astype(np.int64).reshape(len(at), dims)


class Tree:
    """A KD-tree over points with ids; equal points stand together, by id."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, points: np.ndarray, k: int):
        order = np.lexsort((uids, ids, *points.T[::-1]))
        ids, uids, points = ids[order], uids[order], points[order]
        new = np.ones(len(ids), bool)
        new[1:] = (points[1:] != points[:-1]).any(1)
        begin = np.flatnonzero(new)
        keep = np.arange(len(ids)) - np.repeat(begin, np.diff(begin, append=len(ids))) <= k
        self.ids, self.uids, self.points = ids[keep], uids[keep], points[keep]
        self.leaves: list[tuple[int, int]] = []
        perm = np.arange(len(self.ids))
        self._split(perm, 0, len(perm))
        self.ids, self.uids, self.points = self.ids[perm], self.uids[perm], self.points[perm]
        self.lo = np.array([self.points[a:b].min(0) for a, b in self.leaves])
        self.hi = np.array([self.points[a:b].max(0) for a, b in self.leaves])

    def _split(self, perm: np.ndarray, a: int, b: int) -> None:
        """Cut perm[a:b], reordering it, down to leaves."""
        p = self.points[perm[a:b]]
        spread = p.max(0) - p.min(0)
        if b - a <= LEAF or not spread.any():
            self.leaves.append((a, b))
            return
        wide = int(spread.argmax())
        order = p[:, wide].argsort(kind="stable")
        perm[a:b] = perm[a:b][order]
        values = p[order, wide]
        # the cut nearest the median that leaves equal values on one side
        middle = values[len(values) // 2]
        cut = int(np.searchsorted(values, middle)) or int(np.searchsorted(values, middle, "right"))
        self._split(perm, a, a + cut)
        self._split(perm, a + cut, b)


class Best:
    """The k best (score, id) so far of some queries, best first; ties go to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.scores, self.ids = np.full((queries, k), _NONE), np.full((queries, k), _FAR)

    @property
    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, place = np.unique(at, return_inverse=True)
        k = self.scores.shape[1]
        q = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        s, i = np.concatenate([self.scores[rows].ravel(), scores]), np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((i, ~s, q))
        first = np.searchsorted(q[order], np.arange(len(rows)))
        best = order[first[:, None] + np.arange(k)]
        self.scores[rows], self.ids[rows] = s[best], i[best]


def search(tree: Tree, uids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Add to each query's best what the tree holds; a point with the query's own uid is no candidate."""
    largest = max(int(np.abs(tree.points).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1) * max(queries.shape[1], 1)
    if largest >= 1 << 62:
        raise ValueError("scores are too large for whole numbers of 64 bits")
    kind = np.float64 if largest < 1 << 53 else np.int64  # doubles are exact here
    points, q = tree.points.astype(kind), queries.astype(kind)
    bounds = (np.maximum(q, 0) @ tree.hi.astype(kind).T + np.minimum(q, 0) @ tree.lo.astype(kind).T).astype(np.int64)
    order = np.argsort(~bounds, axis=1, kind="stable").T
    bounds = np.sort(bounds, axis=1).T[::-1]
    live = np.arange(len(q))
    for leaf, bound in zip(order, bounds):  # every query's best box, then every one's second best, and so on
        live = live[bound[live] >= best.kth[live]]
        if not len(live):
            break
        by_leaf = live[leaf[live].argsort(kind="stable")]
        cuts = np.flatnonzero(np.diff(leaf[by_leaf], prepend=-1))
        kth, found = best.kth, []
        for group in np.split(by_leaf, cuts[1:]):
            a, b = tree.leaves[leaf[group[0]]]
            s = (q[group] @ points[a:b].T).astype(np.int64)
            x, y = np.nonzero((s >= kth[group][:, None]) & (tree.uids[a:b] != uids[group][:, None]))
            found.append((group[x], tree.ids[a:b][y], s[x, y]))
        at, ids, scores = map(np.concatenate, zip(*found))
        if len(at):
            best.add(at, ids, scores)


def _pass(vectors: DataFrame, block: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], k: int, shard_rows: int) -> DataFrame:
    """query_id, query_uid, vec_id and score of each query's best in each task. Block: (length, ids, uids, vectors)."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)
    names = ["query_id", "query_uid", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {dims: (ids, uids, q, Best(len(ids), k)) for dims, ids, uids, q in shared.value}

        def visit(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for dims, ids, uids, points in _by_length(rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2)):
                if dims in asked:
                    _, own, q, best = asked[dims]
                    tree = Tree(ids, uids, points, k)
                    for a in range(0, len(own), 4096):
                        part = Best(0, k)
                        part.scores, part.ids = best.scores[a : a + 4096], best.ids[a : a + 4096]
                        search(tree, own[a : a + 4096], q[a : a + 4096], part)

        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(a, shard_rows))
                n += held[-1].num_rows
                if n >= shard_rows:
                    visit(held)
                    held, n = [], 0
        if n:
            visit(held)
        for ids, uids, _, best in asked.values():
            for a in range(0, len(ids), 4096):
                x, y = np.nonzero(best.ids[a : a + 4096] != _FAR)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (ids[a + x], uids[a + x], best.ids[a + x, y], best.scores[a + x, y])], names=names,
                )

    return vectors.mapInArrow(run, "query_id long, query_uid long, vec_id long, score long")


def top_k(
    table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, shard_rows: int = 8192, block_bytes: int = 16 << 20,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest inner products of each query, ties to smaller ids."""
    spark = table.sparkSession
    # written, so that the rows' numbers stay what they are
    vectors = written(quantized(table, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors").select("vec_id", "uid", "q")
    asked = vectors.filter(is_query)
    total = asked.agg(F.sum(F.size("q") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    path = scratch_path(spark, "queries")
    asked.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)
    queries = spark.read.schema("vec_id long, uid long, q array<long>, block long").parquet(path)
    found = None
    for b in range(blocks):  # a block is about block_bytes, whatever the table's size
        rows = queries.filter(F.col("block") == b).select("vec_id", "uid", "q").toArrow().combine_chunks()
        block = [x for part in rows.to_batches() for x in _by_length(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2))]
        one = _pass(vectors, block, k, shard_rows)
        if blocks == 1:
            found = one
        else:
            found = found or scratch_path(spark, "top-k")
            one.write.mode("append").parquet(found)
    found = spark.read.parquet(found) if isinstance(found, str) else found
    order = Window.partitionBy("query_id", "query_uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
