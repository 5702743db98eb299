"""What the operators of this subpackage share: the cluster's folder, Arrow slices, worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of text that a Python worker holds as numpy arrays at once; a longer document comes alone.
SLICE_BYTES = 1 << 21
#: The same where each byte of text takes some fifty of arrays.
SMALL_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
            spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a checkpoint in the shared folder: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again (columnar, so cheaper than a checkpoint for wide rows)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver has it on its path (a cluster ships it with --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has at most limit bytes in a string column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string, 0 for null."""
    _, offsets = raw(column)
    return np.diff(offsets)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (a view) and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_text(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """f applied to bounded slices of df in Arrow workers."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit):
            got = f(part)
            yield pa.RecordBatch.from_pydict(got) if isinstance(got, dict) else got

    return df.mapInArrow(run, schema)


def crc32_mod(column: str, n: int):
    """crc32 of an id as text, mod n; null ids give null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
