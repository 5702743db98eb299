import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import knn, scan
from tessella.sources import vecfiles


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("scale,offset", [(1.0, 0.0), (1e-3, 1e3), (1e20, 0.0)])
def test_products_leave_out_nothing(metric, scale, offset):
    r = np.random.default_rng(2)
    x = (offset + scale * r.normal(size=(3000, 16))).astype(np.float32).astype(np.float64)
    x[2500:2600], x[7] = x[:100], x[8]  # ties
    x[100] = 0
    q, ids = x[::30], np.arange(3000)[::-1].copy()
    middle = q.mean(0)
    kept = scan.Dense(np.arange(len(q)), 9)
    for a, b in ((0, 5), (5, 2700), (2700, 3000)):
        knn.nearest_rows(ids[a:b], x[a:b], q, knn.factors(q, metric, middle, True), middle, metric, np.inf, kept)
    for i, one in enumerate(q):
        d = knn.pairwise(x, one, metric)
        order = np.lexsort((ids, d))[:9]
        assert kept.ids[i].tolist() == ids[order].tolist() and kept.distances[i].tolist() == d[order].tolist()


def test_no_query_has_a_step_of_its_own(spark, monkeypatch):
    """All pairs of a table, in few blocks and over all cores, however few files there are."""
    data = vecfiles.from_numpy(spark, np.random.default_rng(4).normal(size=(5000, 64)).astype(np.float32)).coalesce(1).cache()
    calls = []
    blocks = scan.query_blocks
    monkeypatch.setattr(knn.scan, "query_blocks", lambda *a, **b: (calls.append(x) or x for x in blocks(*a, **b)))
    near = knn.exact_knn(data, data.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 5)
    assert near.count() == 25_000 and near.where("rank = 1 and qid <> vec_id").count() == 0 and len(calls) == 1
