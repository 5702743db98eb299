"""Centroids: means, k-means, nearest-centroid assignment, probing."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import importable
from tessella.operators import scan

#: Bytes of centroids that are broadcast; beyond, assignment goes block by block.
BROADCAST_BYTES = 64 << 20


def mean_vector(data: DataFrame, *by: str, vec_col: str = "embedding") -> DataFrame:
    """(by..., mean array<double>): means coordinate by coordinate, summed partially before the shuffle."""
    each = data.select(*by, F.posexplode(vec_col).alias("at", "x")).groupBy(*by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))


def kmeans(data: DataFrame, k: int, metric: str = "l2", seed: int = 42, rounds: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(cluster_id, centroid) by Spark's own k-means. For inner product the rows are clustered by direction (cosine)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = data.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="euclidean" if metric == "l2" else "cosine").fit(rows)
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return data.sparkSession.createDataFrame(found, "cluster_id int, centroid array<double>")


def centroid_blocks(centroids: DataFrame):
    """Ids and matrices of centroids, ascending, at most BROADCAST_BYTES at a time."""
    first = centroids.select(F.size("centroid")).first()
    rows = max(1, BROADCAST_BYTES // (8 * max(1, first[0]))) if first else 1
    return scan.query_blocks(centroids, "cluster_id", "centroid", rows)


def assign(data: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """data with cluster_id, that of the nearest centroid by L2, ties to the smaller id."""
    importable(data.sparkSession)
    out = data.withColumn("_best", F.lit(None).cast("struct<d:double,c:int>"))
    for ids, c in centroid_blocks(centroids):
        held = data.sparkSession.sparkContext.broadcast((ids, c))

        def near(v: pd.Series, held=held) -> pd.DataFrame:
            own, cs = held.value
            x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, cs.shape[1]))
            d = np.stack([((x - one) ** 2).sum(1) for one in cs], axis=1)
            at = d.argmin(axis=1)
            return pd.DataFrame({"d": d[np.arange(len(x)), at], "c": own[at].astype(np.int32)})

        near = F.pandas_udf(_one_argument(near), "struct<d double, c int>")
        found = near(F.col(vec_col))
        out = out.withColumn("_best", F.when(F.col("_best").isNull(), found).otherwise(F.least(F.col("_best"), found)))
    return out.withColumn("cluster_id", F.col("_best.c")).drop("_best")


def _one_argument(f):
    """f as a function of one series, as type hints must show it."""

    def near(v: pd.Series) -> pd.DataFrame:
        return f(v)

    return near


def probe(queries: DataFrame, centroids: DataFrame, n: int, distance: Column | None = None) -> DataFrame:
    """(qid, rank, cluster_id, distance): the n nearest centroids of each query, by L2 whatever the metric."""
    from tessella.operators.knn import exact_knn

    near = exact_knn(centroids, queries, n, "l2", id_col="cluster_id", vec_col="centroid")
    return near.withColumnRenamed("vec_id", "cluster_id")


def sizes(assigned: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(cluster_id, n, least_id, id_sum): sizes of the lists, without gathering a list anywhere."""
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min(id_col).alias("least_id"), F.sum(id_col).alias("id_sum"))
