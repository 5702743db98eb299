"""Vector files: .fvecs/.ivecs (a length before each row) and .fbin/.ibin (one head for all), read in splits and written in parts.

Reading is a Python data source: a file is cut into partitions at whole rows, each read by seek, so a file of any size
is read in parallel and no task holds more than ROWS rows. A file whose size isn't a whole number of rows, or whose
rows differ in length, is an error.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessella import importable

ROWS = 65_536


def layout(path: str) -> tuple[str, int, int]:
    """Kind of number, rows and length of a file."""
    kind, size = os.path.splitext(path)[1].lower(), os.path.getsize(path)
    if kind not in (".fvecs", ".ivecs", ".fbin", ".ibin"):
        raise ValueError(f"{path}: not a vector file")
    number = "<f4" if kind[1] == "f" else "<i4"
    if size == 0:
        return number, 0, 0
    with open(path, "rb") as file:
        head = file.read(8)
    if kind in (".fbin", ".ibin"):
        n, dim = struct.unpack("<II", head)
        if size != 8 + 4 * n * dim:
            raise ValueError(f"{path}: {size} bytes for {n} rows of {dim}")
        return number, n, dim
    dim = struct.unpack("<i", head[:4])[0]
    if dim <= 0 or size % (4 * dim + 4):
        raise ValueError(f"{path}: {size} bytes for rows of {dim}")
    return number, size // (4 * dim + 4), dim


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int
    offset: int

    def __init__(self, path: str, first: int, last: int, offset: int):
        self.path, self.first, self.last, self.offset = path, first, last, offset


def read_rows(path: str, first: int, last: int) -> np.ndarray:
    """Rows first to last (not included) of a file."""
    number, _, dim = layout(path)
    with open(path, "rb") as file:
        if path.lower().endswith("bin"):
            file.seek(8 + 4 * dim * first)
            return np.frombuffer(file.read(4 * dim * (last - first)), number).reshape(last - first, dim)
        file.seek((4 * dim + 4) * first)
        data = file.read((4 * dim + 4) * (last - first))
    heads = np.frombuffer(data, "<i4").reshape(last - first, dim + 1)[:, 0]
    if (heads != dim).any():
        raise ValueError(f"{path}: rows of several lengths")
    return np.frombuffer(data, number).reshape(last - first, dim + 1)[:, 1:]


class VectorReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        paths = sorted(glob(os.path.join(self.path, "part-*"))) if os.path.isdir(self.path) else [self.path]
        out, offset = [], 0
        for p in paths:
            n = layout(p)[1]
            out += [Rows(p, a, min(n, a + self.rows), offset) for a in range(0, n, self.rows)]
            offset += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        for a in range(part.first, part.last, 8192):
            b = min(part.last, a + 8192)
            x = read_rows(part.path, a, b)
            flat = pa.array(np.ascontiguousarray(x).ravel())
            vectors = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * x.shape[1], flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.offset + a, part.offset + b)), vectors], ["vec_id", "embedding"])


class VectorSource(DataSource):
    """format("vectors"): option path, a file or a folder of parts; option rows, rows a partition. vec_id is the place in the file."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        path = self.options["path"]
        first = sorted(glob(os.path.join(path, "part-*"))) if os.path.isdir(path) else [path]
        whole = bool(first) and os.path.splitext(first[0])[1].lower()[1] == "i"
        return f"vec_id long, embedding array<{'int' if whole else 'float'}>"

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options["path"], int(self.options.get("rows", ROWS)))


def read(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(vec_id, embedding) of a vector file or a folder of parts."""
    importable(spark)
    spark.dataSource.register(VectorSource)
    return spark.read.format("vectors").option("path", path).option("rows", rows).load()


def encode_rows(x: np.ndarray, kind: str) -> bytes:
    """Rows as a file holds them, without a head."""
    number = "<f4" if kind[0] == "f" else "<i4"
    body = np.ascontiguousarray(x, dtype=number)
    if kind.endswith("bin"):
        return body.tobytes()
    out = np.empty((len(x), x.shape[1] + 1), "<i4")
    out[:, 0], out[:, 1:] = x.shape[1], body.view("<i4")
    return out.tobytes()


def write(df: DataFrame, path: str, kind: str = "fvecs", id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Writes a folder of parts, by ascending id; fbin and ibin parts each have their own head. path: a folder that all executors share."""
    if kind not in ("fvecs", "ivecs", "fbin", "ibin"):
        raise ValueError(f"no vector file {kind!r}")
    importable(df.sparkSession)
    os.makedirs(path, exist_ok=True)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        target = os.path.join(path, f"part-{number:05d}.{kind}")
        n, dim, scratch = 0, 0, f"{target}.{TaskContext.get().taskAttemptId()}"
        with open(scratch, "wb") as file:
            if kind.endswith("bin"):
                file.write(struct.pack("<II", 0, 0))
            for batch in batches:
                if not batch.num_rows:
                    continue
                sizes = set(batch.column(1).value_lengths().to_pylist())
                if len(sizes | ({dim} if dim else set())) > 1:
                    raise ValueError("vectors of several lengths")
                dim = sizes.pop()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                file.write(encode_rows(x, kind))
                n += batch.num_rows
            if kind.endswith("bin"):
                file.seek(0)
                file.write(struct.pack("<II", n, dim))
        os.replace(scratch, target)  # a repeated task writes the same part again
        if not n:
            os.remove(target)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    df.orderBy(id_col).select(id_col, vec_col).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "vec_id") -> DataFrame:
    """Exactly n rows (all, if fewer), the least by a seeded hash of the id."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def write_sample(df: DataFrame, path: str, n: int, kind: str = "fvecs", seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    write(sample(df, n, seed, id_col), path, kind, id_col, vec_col)


def from_numpy(spark: SparkSession, x: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    """(vec_id, embedding) of a matrix in the driver's memory, converted to rows of 32-bit floats."""
    x = np.ascontiguousarray(x, np.float32)
    if x.ndim != 2:
        raise ValueError(f"a matrix is needed, not {x.ndim} dimensions")
    ids = np.arange(len(x)) if ids is None else np.ascontiguousarray(ids, np.int64)
    if ids.shape != (len(x),):
        raise ValueError("one id a row is needed")
    flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
    return spark.createDataFrame(pa.table({"vec_id": ids, "embedding": flat}))
