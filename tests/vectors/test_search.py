import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as V
from tessella.functions import kernels as K
from tessella.operators import cluster, graphs, knn, metrics, scan
from tessella.operators.ivf import IvfIndex, storage
from tessella.sources import vecfiles
from tessella.streaming.append import append

R = np.random.default_rng(1)
N, D = 600, 64


@pytest.fixture(scope="module")
def x():
    x = R.normal(size=(N, D)).astype(np.float32)
    x[7] = x[3]  # a tie
    return x


@pytest.fixture(scope="module")
def data(spark, x):
    return vecfiles.from_numpy(spark, x).withColumn("label", F.col("vec_id") % 5).cache()


@pytest.fixture(scope="module")
def asked(data):
    return data.where("vec_id < 12").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")).cache()


@pytest.fixture(scope="module")
def centres(data):
    return cluster.mean_vector(data, "label").select(F.col("label").cast("int").alias("cluster_id"), F.col("mean").alias("centroid")).cache()


def brute(x, q, metric, k, where=None):
    x = x.astype(np.float64)
    d = ((x - q) ** 2).sum(1) if metric == "l2" else 1 - x @ q if metric == "ip" else 1 - x @ q / np.sqrt((x * x).sum(1) * (q @ q))
    at = np.arange(len(x)) if where is None else np.flatnonzero(where)
    return [int(i) for i in at[np.lexsort((at, d[at].round(9)))[:k]]]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_exact_search(data, asked, x, metric):
    got = knn.exact_knn(data, asked, 10, metric).toPandas()
    for qid, g in got.groupby("qid"):
        assert g.sort_values("rank").vec_id.tolist() == brute(x, x[qid].astype(np.float64), metric, 10)


def test_filters_radius_blocks_and_small_tables(spark, data, asked, x):
    odd = knn.exact_knn(data, asked, 5, where=F.col("vec_id") % 2 == 1).toPandas()
    for qid, g in odd.groupby("qid"):
        assert g.sort_values("rank").vec_id.tolist() == brute(x, x[qid].astype(np.float64), "l2", 5, np.arange(N) % 2 == 1)
    near = knn.within(data, asked, 90.0).toPandas()
    assert len(near) == sum((((x.astype(float) - x[i].astype(float)) ** 2).sum(1) <= 90.0).sum() for i in range(12))
    blocks = list(scan.query_blocks(asked, block=5))
    assert len(blocks) == 3 and sorted(int(i) for ids, _ in blocks for i in ids) == list(range(12))
    few = knn.exact_knn(data.where("vec_id < 3"), asked, 10)
    assert few.count() == 36 and knn.exact_knn(data, asked, 0).count() == 0
    assert knn.exact_knn(data, asked.where("false"), 10).count() == 0 and knn.exact_knn(data.where("false"), asked, 10).count() == 0
    one = knn.nearest(data, x[5].tolist()).first()
    assert one.vec_id == 5 and one.distance < 1e-9
    assert [r.vec_id for r in knn.knn_by(data, x[9].tolist(), 3, V.squared_l2).collect()] == brute(x, x[9].astype(float), "l2", 3)


def test_bad_input(spark, data, asked):
    for rows in ([(1, [1.0, None])], [(1, [1.0, float("nan")])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)]):
        bad = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        with pytest.raises(Exception):  # noqa: B017
            knn.exact_knn(bad, asked, 1).collect()
    for f in (lambda: knn.exact_knn(data, asked, 1, "l1"), lambda: knn.exact_knn(data, asked, -1), lambda: IvfIndex(64, 10), lambda: IvfIndex(64, metric="l1"), lambda: graphs.QuantizedGraph(64, degree=33), lambda: scan.check_vectors(data, "embedding", "vec_id"), lambda: IvfIndex(64).search(asked, 1, 1)):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_inverted_lists(spark, data, asked, centres, tmp_path, metric):
    truth = knn.exact_knn(data, asked, 10, metric).cache()
    index = IvfIndex(D, 9, metric).build(data, centres)
    found = [metrics.recall(index.search(asked, 10, n), truth, 10).agg(F.avg("recall")).first()[0] for n in (1, 3, 99)]
    assert found == sorted(found) and found[-1] > 0.97
    index.save(str(tmp_path / "i"))
    again = IvfIndex.load(spark, str(tmp_path / "i"))
    a, b = (i.search(asked, 10, 2).toPandas().sort_values(["qid", "rank"]).reset_index(drop=True) for i in (index, again))
    pd.testing.assert_frame_equal(a, b)
    assert again.n_clusters == 5 and again.is_built
    plain, table = (index.search(asked, 10, 5, lut_bits=b).select("qid", "vec_id", F.col("distance").alias(f"d{b}")) for b in (None, 16))
    assert plain.join(table, ["qid", "vec_id"]).agg(F.max(F.abs(F.col("dNone") - F.col("d16")))).first()[0] < 0.05
    held = IvfIndex(D, 1, metric).build(data.withColumnRenamed("label", "cluster_id"), centres)
    assert held.search(asked, 10, 5).count() == 120


def test_metrics(spark, data, asked):
    truth = knn.exact_knn(data, asked, 10)
    same = metrics.recall(truth, truth, 10).agg(F.min("recall")).first()[0]
    ratio = metrics.distance_ratio(truth, truth, 10).toPandas().ratio
    assert same == 1.0 and np.allclose(ratio, 10)
    rows = [(1, i, float(i) - 0.5, float(i) + 0.5) for i in range(30)]
    left = metrics.bounded(spark.createDataFrame(rows, "qid long, vec_id long, low double, high double"), 5)
    assert sorted(r.vec_id for r in left.collect()) == [0, 1, 2, 3, 4, 5]
    assert metrics.column_means(spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "a double, b double"), "a", "b").first() == (2.0, 4.0)
    assert [tuple(r) for r in metrics.reverse_edges(spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "src long, dst long")).orderBy("src").collect()] == [(1, 2), (2, 1)]
    assert storage(spark.createDataFrame([(1,)] * 33 + [(2,)], "cluster_id int"), 64, 5).orderBy("cluster_id").first() == (1, 33, 2, 1280, 1320, 132)


def test_graphs(spark, data, asked, centres, tmp_path):
    truth = knn.exact_knn(data, asked, 10).cache()
    index = graphs.HnswIndex(D, m=8, ef_construction=60, shard=400).build(data, centres, True)
    index.save(str(tmp_path / "h"))
    index = graphs.HnswIndex.load(spark, str(tmp_path / "h"))
    found = [metrics.recall(index.search(asked, 10, ef), truth, 10).agg(F.avg("recall")).first()[0] for ef in (10, 150)]
    assert found[1] >= found[0] - 0.05 and found[1] > 0.9
    most = index.edges.groupBy("shard", "level", "src").count().groupBy(F.col("level") > 0).agg(F.max("count")).collect()
    assert all(n <= (8 if up else 16) for up, n in most)
    index = graphs.QuantizedGraph(D, shard=400).build(data, 60)
    index.save(str(tmp_path / "g"))
    index = graphs.QuantizedGraph.load(spark, str(tmp_path / "g"))
    d = metrics.degrees(index.edges).first()
    assert (d.nodes, d.edges, d.repeated) == (N, 32 * N, 0) and index.edges.where("src = dst").count() == 0
    assert metrics.recall(index.search(asked, 10, 100), truth, 10).agg(F.avg("recall")).first()[0] > 0.95


def test_clusters(spark, data, centres, x):
    got = {r.vec_id: r.cluster_id for r in cluster.assign(data, centres).collect()}
    c = np.array([r.centroid for r in centres.orderBy("cluster_id").collect()])
    assert got == {i: int(((c - v) ** 2).sum(1).argmin()) for i, v in enumerate(x.astype(np.float64))}
    assert cluster.kmeans(data, 3).count() == 3
    old, cluster.BROADCAST_BYTES = cluster.BROADCAST_BYTES, 2 * 8 * D
    try:
        assert {r.vec_id: r.cluster_id for r in cluster.assign(data, centres).collect()} == got
    finally:
        cluster.BROADCAST_BYTES = old


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "fbin", "ibin"])
@pytest.mark.parametrize("dim,n", [(1, 1), (63, 2), (128, 1000)])
def test_vector_files(spark, tmp_path, kind, dim, n):
    x = R.integers(-1000, 1000, (n, dim))
    df = spark.createDataFrame([(i, v) for i, v in enumerate((x if kind[0] == "i" else x.astype(float)).tolist())], f"vec_id long, embedding array<{'int' if kind[0] == 'i' else 'float'}>")
    vecfiles.write(df, str(tmp_path / "v"), kind)
    back = vecfiles.read(spark, str(tmp_path / "v"), rows=300)
    assert {r.vec_id: list(map(int, r.embedding)) for r in back.collect()} == dict(enumerate(x.tolist()))


def test_foreign_files_and_broken_files(spark, tmp_path, data):
    path = tmp_path / "a.fvecs"
    path.write_bytes(b"".join(struct.pack("<i3f", 3, i, i + 1, i + 2) for i in range(5)))
    assert [r.embedding for r in vecfiles.read(spark, str(path), rows=2).orderBy("vec_id").collect()] == [[i, i + 1, i + 2] for i in range(5)]
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(Exception):  # noqa: B017
        vecfiles.read(spark, str(path)).collect()
    (tmp_path / "empty.fbin").write_bytes(b"")
    assert vecfiles.read(spark, str(tmp_path / "empty.fbin")).count() == 0
    vecfiles.write_sample(data, str(tmp_path / "s"), 17)
    assert vecfiles.read(spark, str(tmp_path / "s")).count() == 17 and os.path.getsize(sorted((tmp_path / "s").glob("part-*"))[0]) % (4 * D + 4) == 0


def test_streaming_append(spark, data, centres, asked, tmp_path):
    data.select("vec_id", "embedding").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = IvfIndex(D, 4).build(data, centres)
    append(stream, index, str(tmp_path / "codes"), str(tmp_path / "check")).awaitTermination(120)
    index.codes = spark.read.parquet(str(tmp_path / "codes")).drop("list", "batch")
    whole = IvfIndex(D, 4).build(data, centres)
    key = ["qid", "rank"]
    a, b = (i.search(asked, 10, 3).toPandas().sort_values(key).reset_index(drop=True) for i in (index, whole))
    pd.testing.assert_frame_equal(a, b)


def test_columns(spark):
    row = spark.createDataFrame([([1.0, -2.0, 0.0], [1.0, 1.0, 1.0], [0.5, 1.5, 2.5])], "a array<double>, b array<double>, h array<double>")
    a, b, h = row.a, row.b, row.h
    got = row.select(V.dot(a, b), V.squared_l2(a, b), V.ip_distance(a, b), V.uniform_codes(h, F.lit(0.0), F.lit(1.0)), V.uniform_codes(h, F.lit(0.0), F.lit(1.0), True), V.normalized_residual(a, a)[0], V.pack_bits(V.sign_bits(a), 2), V.unpack_bits(V.pack_bits(V.sign_bits(b), 3), 3), V.cosine_distance(F.array_repeat(F.lit(0.0), 3), b), V.popcount(V.pack_bits(V.sign_bits(b)))).first()
    assert list(got) == [-1.0, 10.0, 2.0, [1, 2, 3], [0, 2, 2], pytest.approx(1 / np.sqrt(3)), [2, 0], [1, 1, 1], None, 3]
    assert K.usual_scale(64, 3) > 0
