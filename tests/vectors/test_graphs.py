import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import kernels as K
from tessella.operators import cluster, graphs, knn, metrics
from tessella.operators.knn import pairwise
from tessella.sources import vecfiles

R = np.random.default_rng(5)


def unit(n: int) -> np.ndarray:
    x = R.normal(size=(n, 64))
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    x = unit(700)
    x[600:] = x[1] + 0.004 * R.normal(size=(100, 64))  # a crowd that codes can't put in order
    data = vecfiles.from_numpy(spark, x).withColumn("label", F.col("vec_id") % 3).cache()
    asked = data.where("vec_id in (1, 3, 5, 650)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")).cache()
    centres = cluster.mean_vector(data, "label").select(F.col("label").cast("int").alias("cluster_id"), F.col("mean").alias("centroid")).cache()
    return data, asked, centres, knn.exact_knn(data, asked, 10).cache()


def test_beam_closes():
    x = unit(1000).astype(np.float64)
    near = np.stack(graphs.neighbours(x, 16, "l2"))
    popped = []

    def score(rows, nodes, js):
        popped.extend(nodes.tolist())
        return ((x[js] - x[7]) ** 2).sum(2)

    graphs.beams(near, np.array([0]), np.array([((x[0] - x[7]) ** 2).sum()]), 20, score)
    assert 20 <= len(popped) < 200 and len(set(popped)) == len(popped) and 7 in popped


def test_shards_are_tasks_of_their_own_and_blocks_share_a_pass(spark, table, monkeypatch):
    data, asked, _, truth = table
    index = graphs.QuantizedGraph(64, shard=100).build(data, 60)
    assert index.graph.rdd.getNumPartitions() >= 7
    monkeypatch.setattr(graphs.scan.query_blocks, "__defaults__", ("qid", "q", 1))
    found = index.search(asked, 10, 40)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert metrics.recall(found, truth, 10).agg(F.min("recall")).first()[0] >= 0.9


def test_layered_graph_with_a_crowd_of_near_copies(table):
    data, asked, centres, truth = table
    index = graphs.HnswIndex(64, ef_construction=60, bits=3, shard=400).build(data, centres, True)
    left = metrics.bounded(index.candidates(asked, 10, 150), 10)
    found = metrics.rerank(left, data, asked, 10)
    assert metrics.recall(found, truth, 10).agg(F.min("recall")).first()[0] >= 0.9


def test_certain_bounds_hold():
    x, q = unit(20_000).astype(np.float64), unit(5).astype(np.float64)
    c = x[:1] * 0.1
    for bits in (1, 2, 5, 8):
        codes = K.encode(x, c, bits, "l2", True)
        for one in q:
            g_add, g_error = K.centre_terms(one, c[0], "l2")
            full = K.estimates(codes, one, g_add, g_error)[2]
            assert (np.abs(full - pairwise(x, one, "l2")) <= K.certain(codes.ex["f_error"], g_error, 64)).all()
