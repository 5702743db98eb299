"""The registered queries: each over whole tables, beside SQL that says the same where SQL can.

Queries are the vectors whose id is a multiple of 50. Scaled vectors (times 1 + vec_id % 5) tell the metrics apart.
Centres are the means of the labels. Numbers are rounded to 6 places at the end only.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import columns as V
from tessella.functions import integers
from tessella.functions import kernels as K
from tessella.operators import cluster, graphs, knn, metrics, quantize, scan
from tessella.operators.ivf import IvfIndex, storage
from tessella.sources import vecfiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 64

#: Common parts of the SQL, by name; a query takes those it names, in this order.
PARTS = {
    "e": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "s": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings",
    "c": f"SELECT label AS cid, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, {DIM + 1}) t(i) GROUP BY label, i) GROUP BY label",
    "p": f"SELECT vec_id, label, v, c, list_transform(range(1, {DIM + 1}), lambda i: v[i] - c[i]) AS r FROM e JOIN c ON label = cid",
    "q": "SELECT vec_id AS qid, v AS q FROM e WHERE vec_id % 50 = 0",
    "sq": "SELECT vec_id AS qid, v AS q FROM s WHERE vec_id % 50 = 0",
    "near": "SELECT vec_id, arg_min(cid, (d, cid)) AS cluster_id FROM (SELECT vec_id, cid, power(list_distance(v, c), 2) AS d FROM e, c) GROUP BY vec_id",
}


def sql(parts: str, body: str) -> str:
    return "WITH " + ",\n".join(f"{p} AS ({PARTS[p]})" for p in parts.split()) + "\n" + body


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def e(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def s(spark: SparkSession, d: str) -> DataFrame:
    return e(spark, d).withColumn("v", V.rescale(F.col("v"), (1 + F.pmod("vec_id", F.lit(5))).cast("double")))


def c(spark: SparkSession, d: str) -> DataFrame:
    return cluster.mean_vector(e(spark, d), "label", vec_col="v").select(F.col("label").alias("cid"), F.col("mean").alias("c"))


def p(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, v, c): vectors with the mean of their label; the planner broadcasts the means once it has seen their size."""
    x = e(spark, d)
    means = c(spark, d)
    return x.join(means, x.label == means.cid).select("vec_id", "v", "c")


def q(data: DataFrame) -> DataFrame:
    return data.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))


def r6(x: Column) -> Column:
    return F.round(x, 6) + F.lit(0.0)


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return c(spark, d).select(F.col("cid").cast("int").alias("cluster_id"), F.col("c").alias("centroid"))


# ---- exact search ----

KNN = "SELECT qid, rank::INTEGER AS rank, vec_id, round(d, 6) + 0.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vec_id) AS rank FROM ({0})) WHERE rank <= 10"
L2, IP = "power(list_distance(v, q), 2)", "1 - list_inner_product(v, q)"
COS = "1 - list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q))"


def _knn(spark, d, metric, **more) -> DataFrame:
    x = s(spark, d)
    return knn.exact_knn(x, q(x), 10, metric, vec_col="v", **more).withColumn("distance", r6(F.col("distance")))


@query(sql("s sq", KNN.format(f"SELECT qid, vec_id, {L2} AS d FROM sq, s")))
def exact_knn_l2(spark, d):
    return _knn(spark, d, "l2")


@query(sql("s sq", KNN.format(f"SELECT qid, vec_id, {IP} AS d FROM sq, s")))
def exact_knn_ip(spark, d):
    return _knn(spark, d, "ip")


@query(sql("s sq", KNN.format(f"SELECT qid, vec_id, {COS} AS d FROM sq, s WHERE vec_id <> -1")))
def exact_knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query(sql("s sq", KNN.format(f"SELECT qid, vec_id, {L2} AS d FROM sq, s WHERE label >= 5")))
def filtered_knn(spark, d):
    return _knn(spark, d, "l2", where=F.col("label") >= 5)


@query(sql("e q", f"SELECT qid, vec_id, round({L2}, 6) + 0.0::DOUBLE AS distance FROM q, e WHERE {L2} <= 1.2"))
def radius_search(spark, d):
    x = e(spark, d)
    return knn.within(x, q(x), 1.2, vec_col="v").withColumn("distance", r6(F.col("distance")))


@query(sql("e", f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, power(list_distance(v, (SELECT list(m ORDER BY i) FROM (SELECT i, avg(v[i]) AS m FROM e, range(1, {DIM + 1}) t(i) GROUP BY i))), 2) AS d FROM e) ORDER BY d, vec_id LIMIT 1"))
def nearest_one(spark, d):
    x = e(spark, d)
    middle = cluster.mean_vector(x, vec_col="v").first()  # one row
    return knn.nearest(x, middle["mean"] if middle else [], vec_col="v").withColumn("distance", r6(F.col("distance")))


# ---- vector functions ----

SUM = "round(list_sum(list_transform(range(1, len({0}) + 1), lambda i: i * {0}[i])), 6) + 0.0::DOUBLE"


@query(sql("s", "SELECT vec_id, round(list_inner_product(v, v), 6) AS norm2, round(list_sum(v), 6) + 0.0::DOUBLE AS total FROM s"))
def vec_norms(spark, d):
    return s(spark, d).select("vec_id", r6(V.squared_norm(F.col("v"))).alias("norm2"), r6(V.total(F.col("v"))).alias("total"))


@query(sql("e", f"SELECT vec_id, {SUM.format('w')} AS place_sum FROM (SELECT vec_id, list_transform(v, lambda x: x * 2.5) AS w FROM e)"))
def vec_rescale(spark, d):
    return e(spark, d).select("vec_id", r6(V.checksum(V.rescale(F.col("v"), 2.5))).alias("place_sum"))


@query(sql("e c p", f"SELECT vec_id, {SUM.format('r')} AS place_sum FROM p"))
def vec_residual(spark, d):
    return p(spark, d).select("vec_id", r6(V.checksum(V.residual(F.col("v"), F.col("c")))).alias("place_sum"))


@query(sql("e c p", "SELECT vec_id, round(list_sum(r) / sqrt(list_inner_product(r, r)), 6) + 0.0::DOUBLE AS total FROM p"))
def vec_normalized_residual(spark, d):
    return p(spark, d).select("vec_id", r6(V.total(V.normalized_residual(F.col("v"), F.col("c")))).alias("total"))


@query(sql("e", "SELECT vec_id, list_min(v) AS lo, list_max(v) AS hi FROM e"))
def vec_minmax(spark, d):
    return e(spark, d).select("vec_id", V.value_range(F.col("v")).alias("x")).select("vec_id", "x.lo", "x.hi")


@query(sql("e", "SELECT vec_id, list_sum(k)::BIGINT AS total, list_sum(list_transform(range(1, 65), lambda i: i * k[i]))::BIGINT AS place_sum FROM (SELECT vec_id, list_transform(v, lambda x: round((x - list_min(v)) / ((list_max(v) - list_min(v)) / 255.0::DOUBLE))::INTEGER) AS k FROM e)"))
def scalar_quantize_u8(spark, d):
    lo, hi = F.array_min("v"), F.array_max("v")
    k = e(spark, d).select("vec_id", V.uniform_codes(F.col("v"), lo, (hi - lo) / 255.0).alias("k"))
    return k.select("vec_id", V.total(F.col("k")).cast("long").alias("total"), V.checksum(F.col("k")).cast("long").alias("place_sum"))


WORD = "list_sum(list_transform(range({0}, {0} + 32), lambda i: CASE WHEN v[i] > 0 THEN (1::BIGINT << ({0} + 31 - i)::INTEGER) ELSE 0 END))::BIGINT"


@query(sql("e", f"SELECT vec_id, {WORD.format(1)} AS high, {WORD.format(33)} AS low FROM e"))
def pack_sign_bits(spark, d):
    w = e(spark, d).select("vec_id", V.pack_bits(V.sign_bits(F.col("v"))).alias("w"))
    return w.select("vec_id", F.element_at("w", 1).alias("high"), F.element_at("w", 2).alias("low"))


@query(sql("e q", "SELECT qid, vec_id, d AS bits, c AS common FROM (SELECT qid, vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (v[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END))::INTEGER AS d, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i] > 0 AND q[i] > 0 THEN 1 ELSE 0 END))::INTEGER AS c FROM q, e) WHERE d <= 20"))
def popcount_hamming(spark, d):
    x = e(spark, d).select("vec_id", V.pack_bits(V.sign_bits(F.col("v"))).alias("w"))
    ask = x.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("qid"), F.col("w").alias("q"))
    return knn.hamming_within(x, ask, 20)


@query(sql("e", "SELECT vec_id, bit_count(w)::INTEGER AS ones, list_sum(list_transform(range(0, 32), lambda i: ((w >> i::INTEGER) & 1) << (31 - i)::INTEGER))::BIGINT AS reversed FROM (SELECT vec_id, " + WORD.format(1) + " AS w FROM e)"))
def bit_reversal(spark, d):
    w = e(spark, d).select("vec_id", V.pack_bits(V.sign_bits(F.col("v"))).alias("w"))
    return w.select("vec_id", F.bit_count(F.element_at("w", 1)).alias("ones"), V.reversed_bits(F.element_at("w", 1)).alias("reversed"))


@query(sql("e c p", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i] > 0 THEN c[i] ELSE 0 END)), 6) + 0.0::DOUBLE AS ip FROM p"))
def masked_product(spark, d):
    return p(spark, d).select("vec_id", r6(V.masked_sum(V.sign_bits(F.col("v")), F.col("c"))).alias("ip"))


_KQ = "list_transform(v, lambda x: round((x - list_min(v)) / ((list_max(v) - list_min(v)) / 15.0::DOUBLE))::INTEGER)"


@query(sql("e", f"SELECT vec_id, round(d * list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[65 - i] > 0 THEN k[i] ELSE 0 END)) + lo * list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)), 6) + 0.0::DOUBLE AS ip FROM (SELECT vec_id, v, list_min(v) AS lo, (list_max(v) - list_min(v)) / 15.0::DOUBLE AS d, {_KQ} AS k FROM e)"))
def bitplane_product(spark, d):
    lo, delta = F.array_min("v"), (F.array_max("v") - F.array_min("v")) / 15.0
    x = e(spark, d).select("vec_id", V.pack_bits(V.sign_bits(F.reverse("v"))).alias("w"), V.bit_planes(V.uniform_codes(F.col("v"), lo, delta), 4).alias("k"), lo.alias("lo"), delta.alias("delta"))
    return x.select("vec_id", r6(V.plane_dot(F.col("w"), F.col("k"), F.col("delta"), F.col("lo"))).alias("ip"))


@query(sql("e", f"SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: ((k[i] >> 0) & 1)::BIGINT << (32 - i)::INTEGER))::BIGINT AS plane0, list_sum(list_transform(range(33, 65), lambda i: ((k[i] >> 3) & 1)::BIGINT << (64 - i)::INTEGER))::BIGINT AS plane3 FROM (SELECT vec_id, {_KQ} AS k FROM e)"))
def query_4bit_planes(spark, d):
    lo, delta = F.array_min("v"), (F.array_max("v") - F.array_min("v")) / 15.0
    x = e(spark, d).select("vec_id", V.bit_planes(V.uniform_codes(F.col("v"), lo, delta), 4).alias("k"))
    return x.select("vec_id", F.col("k")[0][0].alias("plane0"), F.col("k")[3][1].alias("plane3"))


def drawn_sql(seed: int, i: str, j: str = "0") -> str:
    h = f"(({seed * 48271} + ({i} + 1)::BIGINT * 69621 + ({j} + 1)::BIGINT * 40692) % {K.PRIME})"
    for k in (12345, 6789, 101):
        h = f"list_transform([{h}], lambda h{k}: (h{k} * h{k} + {k}) % {K.PRIME})[1]"
    return h


@query(f"SELECT vec_id, 3 + {drawn_sql(42, 'vec_id')} % 15 AS n FROM embeddings")
def random_integers(spark, d):
    return quantize.batches(e(spark, d).select("vec_id"), lambda b: {"vec_id": b.column(0), "n": K.drawn_int(3, 17, 42, b.column(0).to_numpy())}, "vec_id long, n long")


_U, _V = (drawn_sql(42, "vec_id", f"(2 * j + {x})") for x in (0, 1))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(0, 8), lambda j: sqrt(-2 * ln(({_U} + 1) / {K.PRIME}.0::DOUBLE)) * cos(2 * pi() * {_V} / {K.PRIME}.0::DOUBLE))), 6) + 0.0::DOUBLE AS total FROM embeddings")
def gaussian_matrix(spark, d):
    """A row for each vector, made where the vector is."""
    x = quantize.batches(e(spark, d).select("vec_id"), lambda b: {"vec_id": b.column(0), "v": scan.lists(K.gaussian_of(b.column(0).to_numpy(), 8, 42))}, "vec_id long, v array<double>")
    return x.select("vec_id", r6(V.total(F.col("v"))).alias("total"))


@query("SELECT n, (n + 6) // 7 AS sevenths, (n + 63) // 64 * 64 AS padded, length(bin(n)) - 1 AS floor_log2, CASE WHEN n & (n - 1) = 0 THEN length(bin(n)) - 1 ELSE length(bin(n)) END AS ceil_log2, n & (n - 1) = 0 AS power FROM (SELECT vec_id + 1 AS n FROM embeddings)")
def integer_helpers(spark, d):
    def f(b) -> dict:
        n = b.column(0).to_pylist()
        return {"n": n, "sevenths": [integers.ceil_div(x, 7) for x in n], "padded": [integers.padded(x) for x in n], "floor_log2": [integers.floor_log2(x) for x in n], "ceil_log2": [integers.ceil_log2(x) for x in n], "power": [integers.is_power_of_2(x) for x in n]}

    return quantize.batches(e(spark, d).select((F.col("vec_id") + 1).alias("n")), f, "n long, sevenths long, padded long, floor_log2 long, ceil_log2 long, power boolean")


@query("SELECT round(avg(embedding[1]::DOUBLE), 6) + 0.0::DOUBLE AS a, round(avg(embedding[2]::DOUBLE), 6) + 0.0::DOUBLE AS b FROM embeddings")
def column_means(spark, d):
    x = metrics.column_means(e(spark, d).select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b")), "a", "b")
    return x.select(r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


# ---- means, clusters ----


@query(sql("e", f"SELECT i::INTEGER AS at, round(avg(v[i]), 6) + 0.0::DOUBLE AS mean FROM e, range(1, {DIM + 1}) t(i) GROUP BY i"))
def mean_vector(spark, d):
    m = cluster.mean_vector(e(spark, d), vec_col="v")
    return m.select(F.posexplode("mean").alias("at", "x")).select((F.col("at") + 1).alias("at"), r6(F.col("x")).alias("mean"))


@query("SELECT label AS cluster_id, count(*) AS n, min(vec_id) AS least_id, sum(vec_id)::BIGINT AS id_sum FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return cluster.sizes(e(spark, d).withColumnRenamed("label", "cluster_id"))


@query(sql("e c near", "SELECT vec_id, cluster_id FROM near"))
def assign_nearest_centroid(spark, d):
    return cluster.assign(e(spark, d), centroids(spark, d), vec_col="v").select("vec_id", "cluster_id")


@query(sql("e c q", "SELECT qid, rank::INTEGER AS rank, cluster_id::BIGINT AS cluster_id, round(x, 6) AS distance FROM (SELECT qid, cid AS cluster_id, power(list_distance(q, c), 2) AS x, row_number() OVER (PARTITION BY qid ORDER BY list_distance(q, c), cid) AS rank FROM q, c) WHERE rank <= 4"))
def probe_topn(spark, d):
    return cluster.probe(q(e(spark, d)), centroids(spark, d), 4).withColumn("distance", r6(F.col("distance")))


@query(sql("e c near", "SELECT cluster_id, count(*) AS n, ceil(count(*) / 32.0)::BIGINT AS blocks, (ceil(count(*) / 32.0) * 640)::BIGINT AS one_bytes, count(*) * 40 AS ex_bytes, count(*) * 4 AS id_bytes FROM near GROUP BY cluster_id"))
def ivf_storage_bytes(spark, d):
    return storage(cluster.assign(e(spark, d), centroids(spark, d), vec_col="v"), DIM, 5)


@query()
def kmeans_assignment(spark, d):
    x = e(spark, d)
    return cluster.sizes(cluster.assign(x, cluster.kmeans(x, 8, vec_col="v"), vec_col="v"))


# ---- rotations ----


def signs(turn: int) -> str:
    return "[" + ", ".join(str(int(x)) for x in K.sign_of(42, turn, np.arange(DIM))) + "]"


def turn_sql(name: str, table: str, turn: int) -> str:
    flipped = f"SELECT * REPLACE (list_transform(range(1, 65), lambda i: v[i] * {signs(turn)}[i]) AS v) FROM {table}"
    mixed = "list_transform(range(0, 64), lambda j: list_sum(list_transform(range(0, 64), lambda i: CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN v[i + 1] ELSE -v[i + 1] END)) / 8)"
    return f"{name}f AS MATERIALIZED ({flipped}), {name} AS MATERIALIZED (SELECT * REPLACE ({mixed} AS v) FROM {name}f)"


def rotated_sql(table: str) -> str:
    """CTEs table1 to table4: the four rounds."""
    return ", ".join(turn_sql(f"{table}{n + 1}", f"{table}{n}" if n else table, n) for n in range(4))


@query(f"WITH e AS ({PARTS['e']}), {rotated_sql('e')} SELECT vec_id, {SUM.format('v')} AS place_sum, round(v[1], 6) + 0.0::DOUBLE AS first FROM e4")
def rotate_fht64(spark, d):
    x = quantize.rotate(e(spark, d), K.Rotation(DIM))
    return x.select("vec_id", r6(V.checksum(F.col("v"))).alias("place_sum"), r6(F.col("v")[0]).alias("first"))


@query(sql("e", f"SELECT vec_id, {SUM.format('w')} AS place_sum FROM (SELECT vec_id, list_transform(range(1, 65), lambda i: v[i] * {signs(1)}[i]) AS w FROM e)"))
def sign_flip(spark, d):
    x = quantize.rotate(e(spark, d), lambda v: K.flip(v, 42, 1))
    return x.select("vec_id", r6(V.checksum(F.col("v"))).alias("place_sum"))


@query(sql("e", f"SELECT vec_id, {SUM.format('w')} AS place_sum FROM (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= 32 THEN v[i] + v[i + 32] ELSE v[i - 32] - v[i] END) AS w FROM e)"))
def rotate_kac(spark, d):
    x = quantize.rotate(e(spark, d), K.kac_step)
    return x.select("vec_id", r6(V.checksum(F.col("v"))).alias("place_sum"))


@query(sql("e c p", "SELECT vec_id, round(list_inner_product(v, v), 6) AS norm2, round(list_inner_product(v, c), 6) + 0.0::DOUBLE AS ip, true AS turned FROM p"))
def rotate_matrix_norms(spark, d):
    """A rotation keeps norms and inner products (here with the label's mean), and moves every vector."""
    x, turn = p(spark, d), K.Rotation(DIM, "matrix")
    both = quantize.rotate(x, turn).join(quantize.rotate(x, turn, vec_col="c").withColumnRenamed("v", "w"), "vec_id").join(x.select("vec_id", F.col("v").alias("x")), "vec_id")
    return both.select("vec_id", r6(V.squared_norm(F.col("v"))).alias("norm2"), r6(V.dot(F.col("v"), F.col("w"))).alias("ip"), (V.squared_l2(F.col("v"), F.col("x")) > 0.01).alias("turned"))


# ---- quantizers ----


def factor_sql(metric: str, u: str) -> str:
    """f_add, f_rescale, f_error of r about c with direction u."""
    n2, w = "list_inner_product(r, r)", f"list_inner_product(r, {u})"
    error = f"sqrt({n2}) * 1.9 * sqrt(greatest({n2} * list_inner_product({u}, {u}) / ({w} * {w}) - 1, 0) / 63)"
    if metric == "l2":
        return f"{n2} + 2 * {n2} * list_inner_product(c, {u}) / {w} AS f_add, -2 * {n2} / {w} AS f_rescale, 2 * {error} AS f_error"
    return f"1 - list_inner_product(r, c) + {n2} * list_inner_product(c, {u}) / {w} AS f_add, -{n2} / {w} AS f_rescale, {error} AS f_error"


U1 = "list_transform(r, lambda x: CASE WHEN x > 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END)"


def u_sql(ex: int, t: str) -> str:
    """Decoded direction of r on ex bits with scale t; norm is |r|."""
    m = f"least(floor({t} * abs(x) / norm + 1e-5), {(1 << ex) - 1})"
    return f"list_transform(r, lambda x: CASE WHEN x < 0 THEN {(1 << ex) - 1} - {m} - {(1 << ex) - 0.5}::DOUBLE ELSE {m} + 0.5::DOUBLE END)"


R6F = "round(f_add, 6) + 0.0::DOUBLE AS f_add, round(f_rescale, 6) + 0.0::DOUBLE AS f_rescale, round(f_error, 6) + 0.0::DOUBLE AS f_error"
#: The fast scales of this length.
T3, T4, T7 = (K.usual_scale(DIM, ex) for ex in (3, 4, 7))


@query(sql("e c p", "SELECT vec_id, list_sum(list_transform(r, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))::BIGINT AS ones, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN r[i] > 0 THEN i ELSE 0 END))::BIGINT AS place_sum FROM p"))
def onebit_code(spark, d):
    x = quantize.encode(p(spark, d), 1)
    return x.select("vec_id", V.total(F.col("sign")).cast("long").alias("ones"), V.checksum(F.col("sign")).cast("long").alias("place_sum"))


def _factors(spark, d, bits, metric, fast=True, ex="") -> DataFrame:
    x = quantize.encode(p(spark, d), bits, metric, fast)
    return x.select("vec_id", *[r6(F.col(f + ex)).alias(f) for f in ("f_add", "f_rescale", "f_error")])


for _m in ("l2", "ip"):
    query(sql("e c p", f"SELECT vec_id, {R6F} FROM (SELECT vec_id, {factor_sql(_m, 'u')} FROM (SELECT *, {U1} AS u FROM p))"))(lambda spark, d, m=_m: _factors(spark, d, 1, m))
    QUERIES[f"onebit_factors_{_m}"], ORACLES[f"onebit_factors_{_m}"] = QUERIES.pop("<lambda>"), ORACLES.pop("<lambda>")
    for _bits, _t in ((4, T3), (5, T4), (8, T7)):
        query(sql("e c p", f"SELECT vec_id, {R6F} FROM (SELECT vec_id, {factor_sql(_m, 'u')} FROM (SELECT *, {u_sql(_bits - 1, repr(_t) + '::DOUBLE')} AS u FROM (SELECT *, sqrt(list_inner_product(r, r)) AS norm FROM p)))"))(lambda spark, d, m=_m, b=_bits: _factors(spark, d, b, m, True, "_ex"))
        QUERIES[f"ex_factors_{_bits}bit_{_m}"], ORACLES[f"ex_factors_{_bits}bit_{_m}"] = QUERIES.pop("<lambda>"), ORACLES.pop("<lambda>")


def code_sql(ex: int, t: str) -> str:
    m = f"least(floor({t} * abs(x) / norm + 1e-5), {(1 << ex) - 1})"
    return f"list_transform(r, lambda x: (CASE WHEN x < 0 THEN {(1 << ex) - 1} - {m} ELSE {m} END)::INTEGER)"


@query(sql("e c p", f"SELECT vec_id, list_sum(k)::BIGINT AS total, list_sum(list_transform(range(1, 65), lambda i: i * k[i]))::BIGINT AS place_sum FROM (SELECT vec_id, {code_sql(4, repr(T4) + '::DOUBLE')} AS k FROM (SELECT *, sqrt(list_inner_product(r, r)) AS norm FROM p))"))
def ex_code_fast(spark, d):
    x = quantize.encode(p(spark, d), 5, fast=True)
    return x.select("vec_id", V.total(F.col("code")).cast("long").alias("total"), V.checksum(F.col("code")).cast("long").alias("place_sum"))


#: The sweep as a set: all events of all coordinates, running sums in order of their scale.
SWEEP = """n AS (SELECT vec_id, list_transform(r, lambda x: abs(x) / sqrt(list_inner_product(r, r))) AS a FROM p),
b AS (SELECT vec_id, a, 17 / list_max(a) AS t_end FROM n),
l AS (SELECT vec_id, i, a[i] AS a, t_end, floor(t_end * 0.52 * a[i] + 1e-5) AS cur FROM b, range(1, 65) t(i)),
z AS (SELECT vec_id, 16 + sum(cur * cur + cur) AS den, sum((cur + 0.5) * a) AS num FROM l GROUP BY vec_id),
v AS (SELECT vec_id, i, a, step, step / a AS t FROM l, range(1, 20) x(step) WHERE a > 0 AND (step = cur + 1 OR (step > cur + 1 AND step <= 7 AND step / a < t_end))),
w AS (SELECT vec_id, i, t, (num + sum(a) OVER o) / sqrt(den + sum(2 * step) OVER o) AS score FROM v JOIN z USING (vec_id) WINDOW o AS (PARTITION BY vec_id ORDER BY t, i ROWS UNBOUNDED PRECEDING)),
best AS (SELECT vec_id, arg_max(t, score) AS t FROM w GROUP BY vec_id)
"""


@query(sql("e c p", "").rstrip() + ",\n" + SWEEP + "SELECT vec_id, round(t, 6) AS scale FROM best")
def rescale_optimal(spark, d):
    return quantize.best_scales(p(spark, d), 3).withColumn("scale", r6(F.col("scale")))


@query(sql("e c p", "").rstrip() + ",\n" + SWEEP + f"SELECT vec_id, list_sum(k)::BIGINT AS total FROM (SELECT vec_id, {code_sql(3, '(t + 1e-12)')} AS k FROM (SELECT p.*, best.t, sqrt(list_inner_product(r, r)) AS norm FROM p JOIN best USING (vec_id)))")
def ex_code_optimal(spark, d):
    return quantize.encode(p(spark, d), 4).select("vec_id", V.total(F.col("code")).cast("long").alias("total"))


_SCALAR = {"reconstruction": "nd / nu * cs", "unbiased": "nd / nu / cs", "plain": "nd / nu"}
for _mode, _f in _SCALAR.items():
    query(sql("e c p", f"SELECT vec_id, round({_f}, 6) AS delta, round(-({_f}) * 15.5, 6) AS vl FROM (SELECT *, list_inner_product(r, u) / (nd * nu) AS cs FROM (SELECT *, norm AS nd, sqrt(list_inner_product(u, u)) AS nu FROM (SELECT *, {u_sql(4, repr(T4) + '::DOUBLE')} AS u FROM (SELECT *, sqrt(list_inner_product(r, r)) AS norm FROM p))))"))(lambda spark, d, m=_mode: quantize.scalar(p(spark, d), 5, m, True).select("vec_id", r6(F.col("delta")).alias("delta"), r6(F.col("vl")).alias("vl")))
    QUERIES[f"scalar_{_mode}"], ORACLES[f"scalar_{_mode}"] = QUERIES.pop("<lambda>"), ORACLES.pop("<lambda>")


@query(sql("e c p", f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: power(u[i] * delta - r[i], 2))) / 64, 9) AS mse FROM (SELECT *, norm / sqrt(list_inner_product(u, u)) * list_inner_product(r, u) / (norm * sqrt(list_inner_product(u, u))) AS delta FROM (SELECT *, {u_sql(4, repr(T4) + '::DOUBLE')} AS u FROM (SELECT *, sqrt(list_inner_product(r, r)) AS norm FROM p)))"))
def reconstruct_mse(spark, d):
    x = p(spark, d)
    k = quantize.scalar(x, 5, fast=True).join(x, "vec_id")
    back = quantize.reconstruct(F.col("code"), F.col("delta"), F.col("vl"))
    return k.select("vec_id", F.round(V.squared_l2(back, V.residual(F.col("v"), F.col("c"))) / DIM, 9).alias("mse"))


# ---- estimates ----


def _estimates(spark, d, bits, metric) -> DataFrame:
    """Every query against every vector, about the vector's own centre, in bounded blocks of queries."""
    return quantize.estimates(p(spark, d), q(e(spark, d)), bits, metric, True)


def estimate_sql(metric: str, u: str, value: str) -> str:
    g = "power(list_distance(q, c), 2)" if metric == "l2" else "-list_inner_product(q, c)"
    return sql("e c p q", f"SELECT qid, vec_id, {value} FROM (SELECT qid, vec_id, f_add + {g} + f_rescale * list_inner_product(u, q) AS est, f_error * list_distance(q, c) AS error FROM q, (SELECT *, {factor_sql(metric, 'u')} FROM (SELECT *, {u} AS u FROM (SELECT *, sqrt(list_inner_product(r, r)) AS norm FROM p))))")


@query(estimate_sql("l2", U1, "round(est, 6) + 0.0::DOUBLE AS estimate"))
def onebit_estimate_l2(spark, d):
    return _estimates(spark, d, 1, "l2").select("qid", "vec_id", r6(F.col("one")).alias("estimate"))


@query(estimate_sql("ip", U1, "round(est, 6) + 0.0::DOUBLE AS estimate"))
def onebit_estimate_ip(spark, d):
    return _estimates(spark, d, 1, "ip").select("qid", "vec_id", r6(F.col("one")).alias("estimate"))


@query(estimate_sql("l2", U1, "round(est - error, 6) + 0.0::DOUBLE AS low, round(est + error, 6) + 0.0::DOUBLE AS high"))
def onebit_lower_bound(spark, d):
    return _estimates(spark, d, 1, "l2").select("qid", "vec_id", r6(F.col("one") - F.col("error")).alias("low"), r6(F.col("one") + F.col("error")).alias("high"))


@query(estimate_sql("l2", u_sql(4, repr(T4) + "::DOUBLE"), "round(est, 6) + 0.0::DOUBLE AS estimate"))
def boosted_estimate(spark, d):
    return _estimates(spark, d, 5, "l2").select("qid", "vec_id", r6(F.col("full")).alias("estimate"))


@query(estimate_sql("ip", u_sql(4, repr(T4) + "::DOUBLE"), "round(est, 6) + 0.0::DOUBLE AS estimate"))
def full_code_estimate(spark, d):
    return _estimates(spark, d, 5, "ip").select("qid", "vec_id", r6(F.col("full")).alias("estimate"))


# ---- indexes ----


def _ivf(spark, d, metric, bits=5) -> tuple[IvfIndex, DataFrame]:
    x = e(spark, d)
    return IvfIndex(DIM, bits, metric).build(x, centroids(spark, d), fast=True, vec_col="v"), x


def ivf_sql(metric: str) -> str:
    g = "power(list_distance(q, c), 2)" if metric == "l2" else "-list_inner_product(q, c)"
    parts = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in ("e", "c", "near"))
    return f"""WITH {parts}, ec AS (SELECT cid, c AS v FROM c), {rotated_sql('e')}, {rotated_sql('ec')},
q AS (SELECT vec_id AS qid, v AS q FROM e4 WHERE vec_id % 50 = 0),
pr AS (SELECT qid, q, cid, c FROM (SELECT qid, q, cid, v AS c, row_number() OVER (PARTITION BY qid ORDER BY list_distance(q, v), cid) AS n FROM q, ec4) WHERE n <= 4),
p AS (SELECT e4.vec_id, cluster_id, ec4.v AS c, list_transform(range(1, 65), lambda i: e4.v[i] - ec4.v[i]) AS r FROM e4 JOIN near USING (vec_id) JOIN ec4 ON cid = cluster_id),
k AS (SELECT vec_id, cluster_id, u, {factor_sql(metric, 'u')} FROM (SELECT *, {u_sql(4, repr(T4) + '::DOUBLE')} AS u FROM (SELECT *, sqrt(list_inner_product(r, r)) AS norm FROM p))),
h AS (SELECT qid, vec_id, f_add + {g} + f_rescale * list_inner_product(u, q) AS d FROM pr JOIN k ON cid = cluster_id)
SELECT qid, rank::INTEGER AS rank, vec_id, round(d, 6) + 0.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM h) WHERE rank <= 10"""


LUT = f"""WITH {", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in ("e", "c"))}, ec AS (SELECT cid, c AS v FROM c), {rotated_sql('e')}, {rotated_sql('ec')},
b AS (SELECT vec_id AS qid, v AS q, list_transform(range(0, 16), lambda j: v[4 * j + 1:4 * j + 4]) AS b FROM e4 WHERE vec_id % 50 = 0),
t AS (SELECT *, list_min(list_transform(b, lambda x: list_sum(list_transform(x, lambda y: least(y, 0))))) AS lo, list_max(list_transform(b, lambda x: list_sum(list_transform(x, lambda y: greatest(y, 0))))) AS hi FROM b),
p AS (SELECT vec_id, ec4.v AS c, list_transform(range(1, 65), lambda i: e4.v[i] - ec4.v[i]) AS r FROM e4 JOIN ec4 ON cid = label),
k AS (SELECT vec_id, c, list_transform(u, lambda x: x + 0.5) AS bits, {factor_sql('l2', 'u')} FROM (SELECT *, {U1} AS u FROM p)),
h AS (SELECT qid, vec_id, f_add + power(list_distance(q, c), 2) + f_rescale * (list_sum(list_transform(range(0, 16), lambda j: round((list_inner_product(bits[4 * j + 1:4 * j + 4], b[j + 1]) - lo) / ((hi - lo) / 255)))) * (hi - lo) / 255 + 16 * lo - 0.5 * list_sum(q)) AS d FROM t, k)
SELECT qid, rank::INTEGER AS rank, vec_id, round(d, 6) + 0.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM h) WHERE rank <= 10"""


@query(LUT)
def lut8_estimate(spark, d):
    """One-bit estimates through 8-bit tables of the query."""
    x = e(spark, d)
    index = IvfIndex(DIM, 1).build(x.withColumnRenamed("label", "cluster_id"), centroids(spark, d), vec_col="v")
    return index.search(q(x), 10, 10, lut_bits=8).withColumn("distance", r6(F.col("distance")))


@query(ivf_sql("l2"))
def ivf_search_l2(spark, d):
    index, x = _ivf(spark, d, "l2")
    return index.search(q(x), 10, 4).withColumn("distance", r6(F.col("distance")))


@query(ivf_sql("ip"))
def ivf_search_ip(spark, d):
    index, x = _ivf(spark, d, "ip")
    return index.search(q(x), 10, 4).withColumn("distance", r6(F.col("distance")))


@query(sql("e q", KNN.format(f"SELECT qid, vec_id, {L2} AS d FROM q, e")))
def rerank_bounded(spark, d):
    """Candidates whose lower bound passes the k-th upper bound, by exact distance: the exact answer where the bounds hold."""
    index, x = _ivf(spark, d, "l2")
    left = metrics.bounded(index.candidates(q(x), 10, 10), 10)
    return metrics.rerank(left, x, q(x), 10, vec_col="v").withColumn("distance", r6(F.col("distance")))


TRUTH = f"SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS n FROM (SELECT qid, vec_id, {L2} AS d FROM q, e)"


FOUND = f"t AS ({TRUTH}), i AS ({ivf_sql('l2')})"


@query(sql("e q", f", {FOUND} SELECT t.qid, count(i.vec_id) / 10.0::DOUBLE AS recall FROM t LEFT JOIN i ON i.qid = t.qid AND i.vec_id = t.vec_id WHERE n <= 10 GROUP BY t.qid").replace("\n, t AS", ", t AS"))
def recall_at_k(spark, d):
    index, x = _ivf(spark, d, "l2")
    truth = knn.exact_knn(x, q(x), 10, vec_col="v")
    return metrics.recall(index.search(q(x), 10, 4), truth, 10)


@query(sql("e q", f", {FOUND}, f AS (SELECT qid, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS n FROM (SELECT t.* EXCLUDE n FROM t JOIN i USING (qid, vec_id))) SELECT t.qid, round(avg(sqrt(f.d / t.d)) * 10, 6) AS ratio FROM t JOIN f ON t.qid = f.qid AND t.n = f.n WHERE t.n <= 10 AND t.d > 1e-5 GROUP BY t.qid").replace("\n, t AS", ", t AS"))
def distance_ratio(spark, d):
    """The exact distances of what an index finds against the true ones."""
    index, x = _ivf(spark, d, "l2")
    truth = knn.exact_knn(x, q(x), 10, vec_col="v")
    found = metrics.rerank(index.search(q(x), 10, 4), x, q(x), 10, vec_col="v")
    return metrics.distance_ratio(found, truth, 10).withColumn("ratio", r6(F.col("ratio")))


DEGREE = 32
EDGES = f"ed AS (SELECT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY power(list_distance(a.v, b.v), 2), b.vec_id) AS n FROM e a, e b WHERE a.vec_id <> b.vec_id) WHERE n <= {DEGREE})"


def _edges(spark, d) -> DataFrame:
    """The exact neighbours of every vertex: all rows are queries, block by block, against rows dealt to all cores whatever the files."""
    x = e(spark, d)
    near = knn.exact_knn(x.repartition(spark.sparkContext.defaultParallelism), x.select(F.col("vec_id").alias("qid"), F.col("v").alias("q")), DEGREE + 1, vec_col="v").where("qid <> vec_id")
    return scan.ranked(near.drop("rank"), DEGREE).select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"))


@query(sql("e q", f", {EDGES} SELECT DISTINCT * FROM (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed)").replace("\n, ed", ", ed"))
def reverse_edges(spark, d):
    return metrics.reverse_edges(_edges(spark, d))


@query(sql("e q", f", {EDGES} SELECT src, count(DISTINCT dst) AS degree FROM (SELECT src, dst FROM ed UNION ALL SELECT src, dst FROM ed) GROUP BY src").replace("\n, ed", ", ed"))
def edge_dedupe(spark, d):
    x = _edges(spark, d)
    return x.unionByName(x).dropDuplicates(["src", "dst"]).groupBy("src").agg(F.count("*").alias("degree"))


@query(sql("e q", f", {EDGES} SELECT count(DISTINCT src) AS nodes, count(*)::BIGINT AS edges, count(*) / count(DISTINCT src)::DOUBLE AS mean_degree, 0::BIGINT AS repeated FROM ed").replace("\n, ed", ", ed"))
def graph_degrees(spark, d):
    return metrics.degrees(_edges(spark, d))


@query(sql("e q", f", {EDGES}, p AS (SELECT src, dst, a.v AS c, list_transform(range(1, 65), lambda i: b.v[i] - a.v[i]) AS r FROM ed JOIN e a ON a.vec_id = src JOIN e b ON b.vec_id = dst) SELECT src, dst, {R6F} FROM (SELECT src, dst, {factor_sql('l2', 'u')} FROM (SELECT *, {U1} AS u FROM p))").replace("\n, ed", ", ed"))
def qg_edge_codes(spark, d):
    """Neighbours quantized on one bit about their vertex."""
    x, edges = e(spark, d), _edges(spark, d)
    met = edges.join(x.select(F.col("vec_id").alias("src"), F.col("v").alias("c")), "src").join(x.select(F.col("vec_id").alias("dst"), "v"), "dst")
    return _edge_codes(met)


def _edge_codes(met: DataFrame) -> DataFrame:
    """(src, dst, v, c) -> (src, dst, factors): both ids stay whole."""

    def f(b) -> dict:
        one = K.encode(scan.matrix(b.column(2)), scan.matrix(b.column(3)), 1, "l2", False).one
        return {"src": b.column(0), "dst": b.column(1), **{n: one[n] for n in ("f_add", "f_rescale", "f_error")}}

    k = quantize.batches(met.select("src", "dst", "v", "c"), f, "src long, dst long, f_add double, f_rescale double, f_error double")
    return k.select("src", "dst", *[r6(F.col(n)).alias(n) for n in ("f_add", "f_rescale", "f_error")])


@query(f"SELECT vec_id, floor(-ln(({drawn_sql(100, 'vec_id')} + 1) / {K.PRIME}.0::DOUBLE) / ln(16))::BIGINT AS level FROM embeddings")
def hnsw_levels(spark, d):
    return quantize.batches(e(spark, d).select("vec_id"), lambda b: {"vec_id": b.column(0), "level": graphs.levels(b.column(0).to_numpy(), 16, 100)}, "vec_id long, level long")


@query()
def hnsw_search(spark, d):
    """Met by the beams over codes, then by exact distance as far as the codes leave it open."""
    x = e(spark, d)
    index = graphs.HnswIndex(DIM, ef_construction=100, shard=2000).build(x, centroids(spark, d), True, vec_col="v")
    left = metrics.bounded(index.candidates(q(x), 10, 100), 10)
    return metrics.rerank(left, x, q(x), 10, vec_col="v").withColumn("distance", r6(F.col("distance")))


@query()
def qg_search(spark, d):
    x = e(spark, d)
    return graphs.QuantizedGraph(DIM, shard=2000).build(x, 100, vec_col="v").search(q(x), 10, 100).withColumn("distance", r6(F.col("distance")))


#: Share of the ten true neighbours that a graph must find, for every query.
FLOOR = 0.7
RECALLS = "SELECT vec_id AS qid, true AS found FROM embeddings WHERE vec_id % 50 = 0"


def _found(spark, d, search) -> DataFrame:
    x = e(spark, d)
    return metrics.recall(search(spark, d), knn.exact_knn(x, q(x), 10, vec_col="v"), 10).select("qid", (F.col("recall") >= FLOOR).alias("found"))


@query(RECALLS)
def hnsw_recall(spark, d):
    """Whether the search of layered graphs finds at least FLOOR of the true neighbours."""
    return _found(spark, d, hnsw_search)


@query(RECALLS)
def qg_recall(spark, d):
    """Whether the search of quantized graphs finds at least FLOOR of the true neighbours."""
    return _found(spark, d, qg_search)


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def fvecs_roundtrip(spark, d):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = tempfile.mkdtemp(prefix="vectors-", dir=folder.removeprefix("file://") if folder and folder.startswith("file:") else None)
    x = spark.read.parquet(f"{d}/embeddings.parquet")
    vecfiles.write(x, folder, "fvecs")
    back = vecfiles.read(spark, folder)
    return back.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"))
