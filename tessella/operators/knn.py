"""Exact nearest neighbours: brute force with filters, a radius, or a distance of one's own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import METRICS
from tessella.operators import scan


def pairwise(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of x to one query, or each to its own, summed in one order so that equal rows have equal distances."""
    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    ip = (x * q).sum(1)
    if metric in ("ip", "innerproduct"):
        return 1 - ip
    size = np.sqrt((x * x).sum(1) * (q * q).sum(-1))
    return 1 - np.divide(ip, size, out=np.zeros(len(x)), where=size > 0)


#: Bytes of a block of queries with what it keeps; pairs of a query and a row that are compared at once, and rows of them (within a core's cache).
BLOCK_BYTES, PAIRS, TILE = 32 << 20, 1 << 19, 2048


def factors(x: np.ndarray, metric: str, middle: np.ndarray, asked: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows for a product of matrices that gives distances (asked: the side of the queries), and their squared norms."""
    x = x - middle if metric == "l2" else x
    n2 = (x * x).sum(1)
    if metric == "cosine":
        x = np.divide(x, np.sqrt(n2)[:, None], out=np.zeros(x.shape), where=n2[:, None] > 0)
        n2 = (x * x).sum(1)
    one = np.ones(len(x))
    if metric == "l2":
        return np.column_stack([-2 * x, one, n2] if asked else [x, n2, one]), n2
    return np.column_stack([-x, one] if asked else [x, one]), n2


def nearest_rows(ids: np.ndarray, x: np.ndarray, q: np.ndarray, asked: tuple[np.ndarray, np.ndarray], middle: np.ndarray, metric: str, radius: float, kept: scan.Dense) -> None:
    """A batch against all queries. Products of matrices in single precision leave out what is farther than the k-th by more than they can err; pairwise measures the rest."""
    (left, n2), (right, q2), k = factors(x, metric, middle, False), asked, kept.k
    kind = np.float32 if max(n2.max(), q2.max()) < 1e30 else np.float64
    slack = (x.shape[1] + 8) * 2.0**-23 * (1 + n2.max() + q2 if metric != "l2" else n2.max() + q2) + 1e-37
    left, step = np.ascontiguousarray(left.astype(kind)), max(1, PAIRS // min(len(x), TILE))
    right, space = right.astype(kind), np.empty(step * min(len(x), TILE), kind)
    for a in range(0, len(q), step):
        rows, found, least = slice(a, a + step), [], None
        bar = np.minimum(kept.bars(rows), radius)
        new = k and np.isinf(bar).any()  # a first batch has no bar yet: the k-th of its own tiles so far
        for at in range(0, len(x), TILE):
            own = left[at : at + TILE]
            shape = (len(bar), len(own))
            d = np.matmul(right[rows], own.T, out=space[: shape[0] * shape[1]].reshape(shape))
            if new:
                least = d if least is None else np.concatenate([least, d], 1)
                if k < least.shape[1]:
                    least = np.partition(least, k - 1, axis=1)[:, :k].copy()
                    bar = np.minimum(bar, least.max(1) + slack[rows])
                else:
                    least = least.copy()
            hit = np.flatnonzero(d <= np.nextafter((bar + slack[rows]).astype(kind), kind(np.inf))[:, None])
            r, j = np.divmod(hit, shape[1])
            found.append((r, j + at, d.ravel()[hit]))
        i, j, d = (np.concatenate(y) for y in zip(*found))
        near = d <= np.nextafter((bar + slack[rows]).astype(kind), kind(np.inf))[i]
        i, j = i[near] + a, j[near]
        for b in range(0, len(i), 1 << 17):  # a first batch, or one of equals, has many
            r, js = i[b : b + (1 << 17)], j[b : b + (1 << 17)]
            exact = pairwise(x[js], q[r], metric)
            good = exact <= np.minimum(kept.distances[r, -1] if k else -np.inf, radius)
            kept.add(r[good], ids[js[good]], exact[good])


def _check(metric: str, k: int) -> None:
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}: {', '.join(METRICS)}")
    if k < 0:
        raise ValueError("k below 0")


def exact_knn(data: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None, radius: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, rank, vec_id, distance) of queries (qid, q) over data. where: which rows take part; radius: distances up to it only."""
    _check(metric, k)
    scan.check_vectors(data, id_col, vec_col)
    rows = data if where is None else data.where(where)

    def scorer(_, q: np.ndarray):
        kind, middle = "ip" if metric == "innerproduct" else metric, q.mean(0)
        asked = factors(q, kind, middle, True)

        def step(batch, kept: scan.Dense) -> None:
            nearest_rows(batch.column(0).to_numpy(), scan.matrix(batch.column(1), q.shape[1]), q, asked, middle, kind, np.inf if radius is None else radius, kept)

        return step

    first = queries.select(F.size("q").alias("n")).first()
    block = max(1, BLOCK_BYTES // (8 * (max(1, first.n if first else 1) + 2 * k)))
    return scan.search(rows.select(F.col(id_col).cast("long").alias("vec_id"), vec_col), scan.query_blocks(queries, block=block), k, scorer, keeper=scan.Dense)


def within(data: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, vec_id, distance): every row within a radius of a query, from blocks of queries against all rows."""
    _check(metric, 0)
    table = data.select(F.col(id_col).cast("long").alias("vec_id"), vec_col)

    def maker(ids: np.ndarray, q: np.ndarray):
        def run(batches):
            for batch in batches:
                own, x = batch.column(0).to_numpy(), scan.matrix(batch.column(1), q.shape[1])
                for i, one in enumerate(q):
                    d = pairwise(x, one, metric)
                    near = np.flatnonzero(d <= radius)
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[i])), pa.array(own[near]), pa.array(d[near])], schema=scan.NO_HITS)

        return run

    return scan.each(table, scan.query_blocks(queries), maker, scan.HITS)


def hamming_within(bits: DataFrame, queries: DataFrame, most: int, id_col: str = "vec_id", words_col: str = "w") -> DataFrame:
    """(qid, vec_id, bits, common): rows whose packed words differ from a query's (qid, q: words) in at most so many bits, and the bits that both have set."""

    def maker(ids: np.ndarray, q: np.ndarray):
        def run(batches):
            asked = q.astype(np.uint64)
            for batch in batches:
                own, w = batch.column(0).to_numpy(), scan.matrix(batch.column(1), q.shape[1]).astype(np.uint64)
                for i, one in enumerate(asked):
                    d = np.bitwise_count(w ^ one).sum(1).astype(np.int32)
                    near = np.flatnonzero(d <= most)
                    if len(near):
                        yield pa.RecordBatch.from_pydict({"qid": np.full(len(near), ids[i]), "vec_id": own[near], "bits": d[near], "common": np.bitwise_count(w[near] & one).sum(1).astype(np.int32)})

        return run

    return scan.each(bits.select(F.col(id_col).cast("long").alias("vec_id"), words_col), scan.query_blocks(queries), maker, "qid long, vec_id long, bits int, common int")


def knn_by(data: DataFrame, query: list[float], k: int, distance: Callable[[Column, Column], Column], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, distance) of the k nearest of one query, by any Column distance: an ordered limit, so nothing but k rows a task moves."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return data.select(F.col(id_col).alias("vec_id"), distance(F.col(vec_col), q).alias("distance")).orderBy("distance", "vec_id").limit(k)


def nearest(data: DataFrame, query: list[float], metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, distance) of the one nearest row, by partial minima."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = data.select(F.col(id_col).alias("vec_id"), METRICS[metric](F.col(vec_col), q).alias("distance"))
    return d.agg(F.min(F.struct("distance", "vec_id")).alias("m")).select("m.vec_id", "m.distance")
