"""The shape of every search here: a bounded block of queries goes to all partitions, each keeps its own k best, a window merges them.

The k best of each partition are all that is shuffled, whatever the table's size. Queries come in blocks of at most
BLOCK rows, collected and broadcast one block at a time, so what is broadcast is bounded for any number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import importable

BLOCK = 4096
HITS = "qid long, vec_id long, distance double"
NO_HITS = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])


def check_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """df after a look at its schema: a whole-number id and an array of numbers."""
    kinds = dict(df.dtypes)
    if kinds.get(id_col) not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col}: a whole-number column is needed, not {kinds.get(id_col)}")
    if kinds.get(vec_col) not in ("array<float>", "array<double>", "array<int>", "array<bigint>"):
        raise ValueError(f"{vec_col}: an array of numbers is needed, not {kinds.get(vec_col)}")
    return df


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """An Arrow list column as a matrix; ragged rows, nulls and non-finite numbers are errors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("vectors must not be or hold nulls")
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return np.zeros((0, dim or 0))
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1 or (dim is not None and sizes[0] != dim):
        raise ValueError(f"vectors of length {dim or sizes[0]} are needed, not {sizes.tolist()}")
    if not np.isfinite(x).all():
        raise ValueError("vectors must be finite")
    return x.reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


def query_blocks(queries: DataFrame, id_col: str = "qid", vec_col: str = "q", block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of one bounded block of queries after the other."""
    check_vectors(queries, id_col, vec_col)
    n = queries.count()
    blocks = max(1, -(-n // block))
    for i in range(blocks if n else 0):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == i)
        got = part.select(F.col(id_col).cast("long"), vec_col).toArrow()
        ids, x = got.column(0).to_numpy(), matrix(got.column(1))
        order = np.argsort(ids, kind="stable")
        if len(ids):
            yield ids[order], x[order]


def best(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties to the smaller id."""
    if len(ids) > 4 * k:
        bar = np.partition(distances, k - 1)[k - 1] if k else -np.inf
        near = np.flatnonzero(distances <= bar)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], distances[near]))[:k]]


class Kept:
    """The k best of each query so far."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.ids = [np.zeros(0, np.int64) for _ in qids]
        self.distances = [np.zeros(0) for _ in qids]

    def add(self, i: int, ids: np.ndarray, distances: np.ndarray) -> None:
        ids, distances = np.concatenate([self.ids[i], ids]), np.concatenate([self.distances[i], distances])
        at = best(ids, distances, self.k)
        self.ids[i], self.distances[i] = ids[at], distances[at]

    def batch(self) -> pa.RecordBatch:
        n = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.qids, n)), pa.array(np.concatenate([*self.ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*self.distances, np.zeros(0)]))], schema=NO_HITS)


class Dense:
    """The k best of each query so far as matrices, so that hits of many queries are merged at once."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.ids, self.distances = np.full((len(qids), k), -1), np.full((len(qids), k), np.inf)

    def bars(self, rows: slice) -> np.ndarray:
        """Distances above which nothing is kept any more."""
        return self.distances[rows, -1] if self.k else np.full(len(self.qids[rows]), -np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        """Hits, each with the place of its query."""
        own = np.unique(rows)
        if not self.k or not len(own):
            return
        r = np.concatenate([np.repeat(own, self.k), rows])
        i, d = np.concatenate([self.ids[own].ravel(), ids]), np.concatenate([self.distances[own].ravel(), distances])
        order = np.lexsort((i, d, r))
        first = np.searchsorted(r[order], own)[:, None] + np.arange(self.k)
        self.ids[own], self.distances[own] = i[order][first], d[order][first]

    def batch(self) -> pa.RecordBatch:
        r, j = np.nonzero(np.isfinite(self.distances))
        return pa.RecordBatch.from_arrays([pa.array(self.qids[r]), pa.array(self.ids[r, j]), pa.array(self.distances[r, j])], schema=NO_HITS)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, distance): the k nearest hits of each query, ties to the smaller id; fewer if there are fewer."""
    w = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "distance")


def search(table: DataFrame, queries: Iterator[tuple[np.ndarray, np.ndarray]], k: int, scorer: Callable, narrow: Callable | None = None, keeper: type = Kept) -> DataFrame:
    """ranked over table. scorer(ids, q) gives, in a worker, a function (record batch, keeper of the block) -> None; narrow(table, ids, q) prunes the table for a block."""
    spark = table.sparkSession
    importable(spark)
    found = None
    for ids, q in queries:
        held = spark.sparkContext.broadcast((ids, q))  # at most a block

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            kept, step = keeper(held.value[0], k), scorer(*held.value)
            for batch in batches:
                if batch.num_rows:
                    step(batch, kept)
            yield kept.batch()

        hits = (narrow(table, ids, q) if narrow else table).mapInArrow(run, HITS)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], HITS)
    return ranked(found, k)


def each(table: DataFrame, queries: Iterator[tuple[np.ndarray, np.ndarray]], maker: Callable, schema: str, narrow: Callable | None = None) -> DataFrame:
    """Rows of table against blocks of queries. maker(ids, q) gives, in a worker, a function of all its batches that yields batches of the schema; narrow prunes as in search."""
    spark = table.sparkSession
    importable(spark)
    found = None
    for ids, q in queries:
        held = spark.sparkContext.broadcast((ids, q))  # at most a block

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            yield from maker(*held.value)(b for b in batches if b.num_rows)

        rows = (narrow(table, ids, q) if narrow else table).mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found
