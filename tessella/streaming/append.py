"""Appending to an inverted index as vectors arrive: encoding against fixed centroids has no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.ivf import IvfIndex


def append(stream: DataFrame, index: IvfIndex, path: str, checkpoint: str, fast: bool = False, **trigger) -> StreamingQuery:
    """Encodes every micro-batch of stream (vec_id, embedding) and adds it to the codes under path, each batch in a folder of its own that a replay overwrites."""

    def one(batch: DataFrame, number: int) -> None:
        part = IvfIndex(index.dim, index.bits, index.metric, index.rotation).build(batch, index.centroids, fast)
        part.codes.withColumn("list", F.col("cluster_id")).write.mode("overwrite").partitionBy("list").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
