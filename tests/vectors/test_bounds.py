import numpy as np
from pyspark.sql import functions as F

from tessella.operators import knn, metrics
from tessella.operators.ivf import IvfIndex
from tessella.sources import vecfiles


def test_no_true_neighbour_lies_outside_its_bounds(spark):
    x = np.random.default_rng(3).normal(size=(3000, 64))
    data = vecfiles.from_numpy(spark, (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)).withColumn("cluster_id", F.lit(0)).cache()
    asked = data.where("vec_id < 60").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    centres = data.where("vec_id = 0").select(F.lit(0).alias("cluster_id"), F.col("embedding").alias("centroid"))
    kept = IvfIndex(64, 5).build(data, centres, True).candidates(asked, 2000, 1)
    exact = knn.exact_knn(data, asked, 3000)
    met = kept.join(exact, ["qid", "vec_id"])
    assert met.count() >= 60 * 2000 and met.where("distance < low or distance > high").count() == 0
    left = metrics.bounded(kept, 2000)
    assert exact.where("rank <= 2000").join(left, ["qid", "vec_id"], "left_anti").count() == 0
