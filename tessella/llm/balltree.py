"""Exact top-k by inner product: a ball tree a shard, branch and bound, the kth score shared.

Candidates are split by a hash into shards of about SHARD vectors, queries into blocks of about BLOCK. A first wave
searches each block in one shard, the blocks spread evenly over the shards; its kth scores are exact lower bounds of the
final ones and go into the second wave, which searches all other shards. Within a task the kth score of a query is carried on from shard to shard. In a tree,
nodes are taken in the order of their bound <q, centre> + |q| radius, and a query leaves a tree when the best bound left
is below its kth score (ties are searched, for the smaller id).

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do null ids; a query is
compared with vectors of its own length only; a repeated id is another row, but every row with the query's id counts as
its own, and query rows equal in id and vector are one query; fewer candidates than k give fewer rows; an empty table gives none. Scores are exact (beyond 2 ** 53 in Python
integers) and held within the range of a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import importable, reliable

SHARD, BLOCK, LEAF = 8192, 512, 256
LONG = (1 << 63) - 1
OUT = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes over rows of a matrix: centre, radius, and two children or a run of rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.child, self.rows = [], [], [], []
        self._build(points, 0, len(points), leaf)
        self.points, self.ids = points[self.order], ids[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _build(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        node, own = len(self.centre), points[self.order[a:b]]
        middle = own.mean(axis=0)
        self.centre.append(middle)
        self.radius.append(float(np.sqrt(((own - middle) ** 2).sum(axis=1).max())))
        self.child.append(None)
        self.rows.append((a, b))
        if b - a > leaf:
            far = own[((own - middle) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own @ (other - far), half)]
            self.child[node] = self._build(points, a, a + half, leaf), self._build(points, a + half, b, leaf)
        return node

    def search(self, queries: np.ndarray, query_ids: np.ndarray, kth: list[list], k: int) -> None:
        """Improves kth, a heap of (score, -id) for each query, of at most k."""
        size = np.sqrt((queries**2).sum(axis=1))
        bound = queries @ self.centre.T + size[:, None] * self.radius
        bound += 1e-9 * (np.abs(bound) + size[:, None] * (self.radius + 1)) + 1e-6
        largest = size.max(initial=0) * np.sqrt((self.points**2).sum(axis=1).max(initial=0))
        whole = largest >= 2.0**52
        points = np.array([[int(x) for x in row] for row in self.points], object) if whole else self.points
        for i, own in enumerate(query_ids.tolist()):
            heap, best = [(-bound[i, 0], 0)], kth[i]
            q = np.array([int(x) for x in queries[i]], object) if whole else queries[i]
            while heap:
                upper, node = heapq.heappop(heap)
                if len(best) == k and -upper < best[0][0]:
                    break
                if self.child[node]:
                    for x in self.child[node]:
                        heapq.heappush(heap, (-bound[i, x], x))
                    continue
                a, b = self.rows[node]
                scores = points[a:b] @ q if points.shape[1] else np.zeros(b - a)
                good = np.arange(a, b)
                if len(best) == k:
                    keep = scores >= best[0][0]
                    good, scores = good[keep], scores[keep]
                elif len(scores) > 4 * k and not whole:
                    keep = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    good, scores = good[keep], scores[keep]
                    if (self.ids[good] == own).sum() > 1:  # the query's own rows may have taken places
                        good, scores = np.arange(a, b), points[a:b] @ q
                for s, x in zip(scores.tolist(), self.ids[good].tolist()):
                    if x != own:
                        item = (int(s), -x)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)


def _by_length(ids: np.ndarray, dims: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the places of its vectors, and they as a matrix."""
    before = np.concatenate([[0], np.cumsum(dims)])
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, flat[before[at][:, None] + np.arange(dim)]


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        at, trees = None, {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                ids, dims, flat, bars = (row[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "dims", "vecs", "kth"))
                if row["block"].as_py() < 0:  # the shard comes before the blocks that search it
                    at, trees = row["shard"].as_py(), {dim: BallTree(m, ids[rows]) for dim, rows, m in _by_length(ids, dims, flat)}
                    continue
                if row["shard"].as_py() != at:
                    continue  # a shard without candidates
                found: list[tuple] = []
                for dim, rows, queries in _by_length(ids, dims, flat):
                    if dim not in trees:
                        continue
                    floors = [max(bar, known.get(q, -np.inf)) for q, bar in zip(ids[rows].tolist(), bars[rows].tolist())]
                    # a kth score known from elsewhere stands as k places just below it
                    best: list[list] = [[(int(x) - 1, 0)] * k if np.isfinite(x) else [] for x in floors]
                    trees[dim].search(queries, ids[rows], best, k)
                    for q, floor, heap in zip(ids[rows].tolist(), floors, best):
                        good = [(q, -x, s) for s, x in heap if s >= floor]
                        if len(good) == k:
                            known[q] = float(min(s for _, _, s in good))
                        found += good
                if found:
                    a, b, c = zip(*found)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array([max(-LONG, min(LONG, x)) for x in c], pa.int64())})

    return run


def _floor(x: Column) -> Column:
    """As a double; beyond 2 ** 53 every double is whole, and a long might not hold it."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id long, v array<double>) of the usable rows, each component floor(scale * x)."""
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return usable.where(F.coalesce(fine, F.lit(False))).select("id", F.transform("v", lambda x: _floor(x.cast("double") * F.lit(scale))).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (id, v) with is_query the k other rows with the largest inner product, ties to the smaller id."""
    importable(vectors.sparkSession)
    rows = reliable(vectors)
    n, asking = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asking // block))

    def pack(x: DataFrame, *keys: str) -> DataFrame:
        held = F.collect_list(F.struct("id", "v", "kth")).alias("x")  # of one shard or one block, so bounded
        return x.groupBy(*keys).agg(held).select(*keys, F.col("x.id").alias("ids"), F.transform("x.v", F.size).alias("dims"), F.flatten("x.v").alias("vecs"), F.col("x.kth").alias("kth"))

    unknown = F.lit(float("-inf"))
    packed = reliable(pack(rows.withColumn("kth", unknown).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))), "shard").withColumn("block", F.lit(-1).cast("long")))
    asked = rows.where(is_query).dropDuplicates(["id", "v"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)))

    def wave(first: bool, bars: DataFrame | None) -> DataFrame:
        """Each block, bounded, in the shard of its number (first), or in all others."""
        q = asked.withColumn("kth", unknown) if bars is None else asked.join(bars.withColumnRenamed("query_id", "id"), "id", "left").withColumn("kth", F.coalesce("kth", unknown))
        own, packs = F.pmod("block", F.lit(shards)), pack(q, "block")
        each = packs.withColumn("shard", own) if first else packs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where(F.col("shard") != own)
        met = packed.unionByName(each)
        return met.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "block").mapInArrow(_searcher(k), OUT)

    found = reliable(wave(True, None))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        bars = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") >= k).select("query_id", "kth")
        found = found.union(wave(False, bars))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
