import numpy as np
from pyspark.sql import functions as F

from tessella.operators import quantize
from tessella.sources import vecfiles


def test_every_pair_once_in_short_turns(spark):
    x = np.random.default_rng(6).normal(size=(2500, 64)).astype(np.float32)
    data = vecfiles.from_numpy(spark, x).coalesce(1).select("vec_id", F.col("embedding").alias("v"), F.array_repeat(F.lit(0.1), 64).alias("c"))
    asked = data.where("vec_id < 40").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    rows = quantize.estimates(data, asked, 1).select("qid", "vec_id").toArrow()
    qid, vec_id = (rows.column(c).to_numpy() for c in ("qid", "vec_id"))
    assert len(set(zip(qid.tolist(), vec_id.tolist()))) == len(qid) == 40 * 2500
    again = np.flatnonzero(vec_id == vec_id[0])
    assert len(again) == 40 and np.median(np.diff(again)) <= 1000  # an id comes again within a compressed block
