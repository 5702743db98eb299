"""Rotation and quantization of DataFrames in Arrow batches: no shuffle, one pass, a slice of rows in memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import importable
from tessella.functions import kernels as K
from tessella.operators import scan
from tessella.operators.scan import lists, matrix


#: Rows that all queries of a block ask before the next: their ids come again so soon that a compressed file holds them once a stretch.
TURN = 1000


def batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    importable(df.sparkSession)

    def run(parts):
        for batch in parts:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(f(batch))

    return df.mapInArrow(run, schema)


def rotate(df: DataFrame, rotation: Callable[[np.ndarray], np.ndarray], id_col: str = "vec_id", vec_col: str = "v") -> DataFrame:
    """(vec_id, v array<double>) rotated and padded. rotation: any function of a matrix, or a kernels.Rotation."""
    return batches(df.select(F.col(id_col).cast("long"), vec_col), lambda b: {"vec_id": b.column(0), "v": lists(rotation(matrix(b.column(1))))}, "vec_id long, v array<double>")


def _ints(x: np.ndarray) -> pa.Array:
    return lists(x.astype(np.int32))


def encode(df: DataFrame, bits: int, metric: str = "l2", fast: bool = False) -> DataFrame:
    """df (vec_id, v, c) -> sign bits, magnitudes, and their factors about c."""
    K.check_bits(bits)

    def f(b: pa.RecordBatch) -> dict:
        x = K.encode(matrix(b.column(1)), matrix(b.column(2)), bits, metric, fast)
        return {"vec_id": b.column(0), "sign": _ints(x.sign), **x.one, "code": _ints(x.code), "f_add_ex": x.ex["f_add"], "f_rescale_ex": x.ex["f_rescale"], "f_error_ex": x.ex["f_error"]}

    return batches(df.select(F.col("vec_id").cast("long"), "v", "c"), f, "vec_id long, sign array<int>, f_add double, f_rescale double, f_error double, code array<int>, f_add_ex double, f_rescale_ex double, f_error_ex double")


def scalar(df: DataFrame, bits: int, mode: str = "reconstruction", fast: bool = False) -> DataFrame:
    """df (vec_id, v, c) -> (vec_id, code array<int>, delta, vl): code * delta + vl stands for v - c."""
    K.check_bits(bits)
    if mode not in ("reconstruction", "unbiased", "plain"):
        raise ValueError(f"no mode {mode!r}")

    def f(b: pa.RecordBatch) -> dict:
        code, delta, vl = K.scalar_quantize(matrix(b.column(1)), matrix(b.column(2)), bits, mode, fast)
        return {"vec_id": b.column(0), "code": _ints(code), "delta": delta, "vl": vl}

    return batches(df.select(F.col("vec_id").cast("long"), "v", "c"), f, "vec_id long, code array<int>, delta double, vl double")


def reconstruct(code, delta, vl):
    """Column of code * delta + vl."""
    return F.transform(code, lambda x: x * delta + vl)


def best_scales(df: DataFrame, ex: int) -> DataFrame:
    """df (vec_id, v, c) -> (vec_id, scale): the best scale of each residual."""

    def f(b: pa.RecordBatch) -> dict:
        r = np.abs(matrix(b.column(1)) - matrix(b.column(2)))
        size = np.sqrt((r * r).sum(1))
        return {"vec_id": b.column(0), "scale": np.array([K.best_scale(row / s, ex) if s else 0.0 for row, s in zip(r, size)])}

    return batches(df.select(F.col("vec_id").cast("long"), "v", "c"), f, "vec_id long, scale double")


def estimates(df: DataFrame, queries: DataFrame, bits: int, metric: str = "l2", fast: bool = False) -> DataFrame:
    """df (vec_id, v, c) against queries (qid, q), block by block -> (qid, vec_id, one, full, error): every row's one-bit and full estimate of its distance to every query, and the error bound of the first."""
    K.check_bits(bits)
    schema = "qid long, vec_id long, one double, full double, error double"

    def maker(ids: np.ndarray, q: np.ndarray):
        def run(parts):
            for b in parts:
                ids_, xs, cs = b.column(0).to_numpy(), matrix(b.column(1)), matrix(b.column(2))
                for a in range(0, len(xs), TURN):
                    own, x, c = ids_[a : a + TURN], xs[a : a + TURN], cs[a : a + TURN]
                    codes = K.encode(x, c, bits, metric, fast)
                    codes.sign, codes.code = codes.sign.astype(np.float64), codes.code.astype(np.float64)  # once, not for each query
                    for n in range(0, len(q), 16):
                        found = [K.estimates(codes, one, *K.centre_terms(one, c, metric)) for one in q[n : n + 16]]
                        one, low, full = (np.concatenate([y[k] for y in found]) for k in range(3))
                        yield pa.RecordBatch.from_pydict({"qid": np.repeat(ids[n : n + 16], len(x)), "vec_id": np.tile(own, len(found)), "one": one, "full": full, "error": one - low})

        return run

    return scan.each(df.select(F.col("vec_id").cast("long"), "v", "c"), scan.query_blocks(queries), maker, schema)
