"""Inverted lists: quantized codes under their centroids, probed, estimated and ranked.

An index is a folder of Parquet tables: meta, centroids, codes (partitioned by cluster_id). A search sends a bounded
block of queries with their probes to the codes, of which only the probed partitions are read, and merges each
partition's k best. Lists of any size are read as a stream of batches, so a hot list is spread over as many tasks as its
files have splits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import importable
from tessella.functions import kernels as K
from tessella.operators import cluster, scan

CODES = "vec_id long, cluster_id int, sign binary, f_add double, f_rescale double, f_error double, code binary, f_add_ex double, f_rescale_ex double, f_error_ex double"


def metric_of(name: str) -> str:
    try:
        return {"l2": "l2", "ip": "ip", "innerproduct": "ip"}[name.lower()]
    except KeyError:
        raise ValueError(f"no metric {name!r}: l2, ip") from None


def pack_rows(ids, cluster_ids, codes: K.Codes) -> pa.RecordBatch:
    ex = codes.bits - 1
    return pa.RecordBatch.from_pydict({
        "vec_id": pa.array(ids), "cluster_id": pa.array(np.asarray(cluster_ids, np.int32)), "sign": pa.array(K.pack_codes(codes.sign, 1), pa.binary()), **{f: pa.array(codes.one[f]) for f in ("f_add", "f_rescale", "f_error")},
        "code": pa.array(K.pack_codes(codes.code, ex), pa.binary()) if ex else pa.array([b""] * len(ids), pa.binary()), "f_add_ex": pa.array(codes.ex["f_add"]), "f_rescale_ex": pa.array(codes.ex["f_rescale"]), "f_error_ex": pa.array(codes.ex["f_error"]),
    })


def unpack_rows(batch, size: int, bits: int) -> K.Codes:
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    one = {f: col(f).to_numpy() for f in ("f_add", "f_rescale", "f_error")}
    code = K.unpack_codes(col("code").to_pylist(), size, bits - 1) if bits > 1 else np.zeros((batch.num_rows, size), np.int64)
    return K.Codes(bits, K.unpack_codes(col("sign").to_pylist(), size, 1), one, code, {"f_add": col("f_add_ex").to_numpy(), "f_rescale": col("f_rescale_ex").to_numpy(), "f_error": col("f_error_ex").to_numpy()})


@dataclass
class IvfIndex:
    """bits 1 to 9 a coordinate; metric l2 or ip."""

    dim: int
    bits: int = 5
    metric: str = "l2"
    rotation: K.Rotation | None = None
    centroids: DataFrame | None = None
    codes: DataFrame | None = None

    def __post_init__(self):
        K.check_bits(self.bits)
        self.metric = metric_of(self.metric)
        self.rotation = self.rotation or K.Rotation(self.dim)
        if self.rotation.dim != self.dim:
            raise ValueError("the rotation is of another length")

    @property
    def is_built(self) -> bool:
        return self.codes is not None

    @property
    def n_clusters(self) -> int:
        return self.centroids.count()

    def _need(self) -> None:
        if not self.is_built:
            raise ValueError("the index isn't built")

    def build(self, data: DataFrame, centroids: DataFrame, fast: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> IvfIndex:
        """From data, with a column cluster_id or else assigned here, and centroids (cluster_id, centroid)."""
        scan.check_vectors(data, id_col, vec_col)
        if "cluster_id" not in data.columns:
            data = cluster.assign(data, centroids, id_col, vec_col)
        importable(data.sparkSession)
        rotation, bits, metric = self.rotation, self.bits, self.metric
        found = list(cluster.centroid_blocks(centroids))  # bounded: K centroids, in blocks
        ids, c = np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found])
        held = data.sparkSession.sparkContext.broadcast((ids, rotation(c)))

        def run(batches):
            own, cs = held.value
            for batch in batches:
                if batch.num_rows:
                    x = rotation(scan.matrix(batch.column(2), rotation.dim))
                    at = np.searchsorted(own, batch.column(1).to_numpy(zero_copy_only=False))
                    if (at >= len(own)).any() or (own[np.minimum(at, len(own) - 1)] != batch.column(1).to_numpy(zero_copy_only=False)).any():
                        raise ValueError("a cluster_id without a centroid")
                    yield pack_rows(batch.column(0), batch.column(1), K.encode(x, cs[at], bits, metric, fast))

        rows = data.select(F.col(id_col).cast("long").alias("vec_id"), F.col("cluster_id").cast("int").alias("cluster_id"), vec_col)
        self.codes, self.centroids = rows.mapInArrow(run, CODES), centroids.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("centroid").cast("array<double>").alias("centroid"))
        return self

    def _probing(self, nprobe: int) -> tuple:
        """Codes, ids and centroids of the lists, the lists that each query asks, and the pruning of the codes for a block."""
        self._need()
        if nprobe < 1:
            raise ValueError("nprobe below 1")
        found = list(cluster.centroid_blocks(self.centroids))
        cids, c = np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found])

        def probes(q: np.ndarray) -> list[np.ndarray]:
            return [scan.best(cids, ((c - one) ** 2).sum(1), min(nprobe, len(cids))) for one in q]

        def narrow(table: DataFrame, _, q: np.ndarray) -> DataFrame:
            return table.where(F.col("cluster_id").isin(sorted({int(cids[i]) for p in probes(q) for i in p})))

        return self.codes, cids, c, probes, narrow

    def candidates(self, queries: DataFrame, k: int, nprobe: int, slack: float = 1.0) -> DataFrame:
        """(qid, vec_id, low, high): rows of the probed lists whose lower bound is at most the k-th least upper bound seen in their task; metrics.bounded finishes the job. The bounds are certain: no estimate lies outside. slack widens them."""
        table, cids, c, probes, narrow = self._probing(nprobe)
        rotation, bits, metric = self.rotation, self.bits, self.metric
        shape = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

        def maker(ids: np.ndarray, q: np.ndarray):
            rotated, centres = rotation(q), rotation(c)
            asks: dict[int, list[int]] = {}
            for i, p in enumerate(probes(q)):
                for at in p:
                    asks.setdefault(int(at), []).append(i)

            def run(batches):
                kept = [np.zeros((0, 3)) for _ in ids]
                for batch in batches:
                    own, lists_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    for cid in np.unique(lists_):
                        at, rows = int(np.searchsorted(cids, cid)), np.flatnonzero(lists_ == cid)
                        codes = unpack_rows(batch.take(pa.array(rows)), rotation.size, bits)
                        for i in asks.get(at, ()):
                            g_add, g_error = K.centre_terms(rotated[i], centres[at], metric)
                            full = K.estimates(codes, rotated[i], g_add, g_error)[2]
                            width = K.certain(codes.ex["f_error"], g_error, rotation.size) * slack
                            now = np.concatenate([kept[i], np.column_stack([own[rows], full - width, full + width])])
                            bar = np.partition(now[:, 2], k - 1)[k - 1] if len(now) >= k > 0 else np.inf
                            kept[i] = now[now[:, 1] <= bar]
                for qid, x in zip(ids, kept):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), qid)), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1]), pa.array(x[:, 2])], schema=shape)

            return run

        return scan.each(table, scan.query_blocks(queries), maker, "qid long, vec_id long, low double, high double", narrow)

    def search(self, queries: DataFrame, k: int, nprobe: int, lut_bits: int | None = None, bounds: bool = False) -> DataFrame:
        """(qid, rank, vec_id, distance) by estimate over the nprobe nearest lists of queries (qid, q).

        lut_bits 8 or 16: one-bit products through tables of so many bits; None: exact. bounds: candidates' lower bounds
        in place of estimates (for re-ranking).
        """
        table, cids, c, probes, narrow = self._probing(nprobe)
        rotation, bits, metric = self.rotation, self.bits, self.metric

        def scorer(_, q: np.ndarray):
            rotated, centres = rotation(q), rotation(c)
            asks: dict[int, list[int]] = {}
            for i, p in enumerate(probes(q)):
                for at in p:
                    asks.setdefault(int(at), []).append(i)
            tables = [K.lookup_table(one, lut_bits) for one in rotated] if lut_bits else None

            def step(batch, kept: scan.Kept) -> None:
                ids, lists_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for cid in np.unique(lists_):
                    at = int(np.searchsorted(cids, cid))
                    rows = np.flatnonzero(lists_ == cid)
                    codes = unpack_rows(batch.take(pa.array(rows)), rotation.size, bits)
                    for i in asks.get(at, ()):
                        g_add, g_error = K.centre_terms(rotated[i], centres[at], metric)
                        est, low, full, full_low = K.estimates(codes, rotated[i], g_add, g_error)
                        if tables:
                            off = (K.table_dot(codes.sign, *tables[i]) - codes.sign @ rotated[i])
                            full = full + (codes.ex["f_rescale"] * (1 << (bits - 1)) if bits > 1 else codes.one["f_rescale"]) * off
                        kept.add(i, ids[rows], full_low if bounds else full)

            return step

        return scan.search(table, scan.query_blocks(queries), k, scorer, narrow)

    def save(self, path: str) -> None:
        self._need()
        spark = self.codes.sparkSession
        meta = {"dim": self.dim, "bits": self.bits, "metric": self.metric, **{f"rotation_{a}": b for a, b in self.rotation.to_json().items()}}
        spark.createDataFrame([tuple(meta.values())], list(meta)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        # a file a list and task; hot lists stay spread over several tasks
        self.codes.withColumn("list", F.col("cluster_id")).repartition("cluster_id", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        m = spark.read.parquet(f"{path}/meta").first()
        rotation = K.Rotation(m.rotation_dim, m.rotation_kind, m.rotation_seed, m.rotation_size)
        index = cls(m.dim, m.bits, m.metric, rotation)
        index.centroids, stored = spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/codes")
        index.codes = stored.select(*[f.split()[0] for f in CODES.split(", ") if not f.startswith("cluster_id")][:1], F.col("list").cast("int").alias("cluster_id"), *[f.split()[0] for f in CODES.split(", ")][2:])
        if stored.select("list").distinct().join(index.centroids, F.col("list") == F.col("cluster_id"), "left_anti").limit(1).count():
            raise ValueError(f"{path}: codes of a list without a centroid")
        return index


def storage(assigned: DataFrame, dim: int, bits: int) -> DataFrame:
    """(cluster_id, n, blocks, one_bytes, ex_bytes, id_bytes) of the lists, by formula."""
    size = K.record_bytes(K.padded(dim), bits)
    n = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / 32)
    return n.select("cluster_id", "n", blocks.alias("blocks"), (blocks * size["block"]).alias("one_bytes"), (F.col("n") * size["ex"]).alias("ex_bytes"), (F.col("n") * 4).alias("id_bytes"))

