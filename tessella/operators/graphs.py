"""Graph indexes: layered small worlds on codes, and quantized graphs with codes on their edges.

A beam search walks one step after another, so it is the queries and the shards that run in parallel: the data are cut
into shards of about SHARD rows by a hash of the id, each shard gets a graph of its own, built in one task from exact
neighbours in blocks, and a search takes the k best of every shard. No task ever holds more than a shard and a block of
queries, and the graphs' tables only grow in rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import importable
from tessella.functions import kernels as K
from tessella.operators import cluster, scan
from tessella.operators.ivf import metric_of
from tessella.operators.knn import pairwise

SHARD = 20_000
#: Rows of a shard up to which a task holds all of its distances (128 MB).
HELD = 4096
#: Pairs of queries and rows of a shard that are searched in step.
STEP = 1 << 20


def sharded(data: DataFrame, shard: int, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(shard, vec_id, embedding), and over how many partitions to deal the shards."""
    n = max(1, -(-data.count() // shard))
    rows = data.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("shard"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    return rows, 2 * n


def neighbours(x: np.ndarray, n: int, metric: str, rows: np.ndarray | None = None, block: int = 512) -> list[np.ndarray]:
    """For each row the places of its n nearest others, by distance and place; in blocks, so never a whole square."""
    rows = np.arange(len(x)) if rows is None else rows
    own, size = x[rows], (x[rows] ** 2).sum(1)
    out = []
    for a in range(0, len(rows), block):
        ip = own[a : a + block] @ own.T
        d = size[a : a + block, None] + size - 2 * ip if metric == "l2" else 1 - ip
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        m = min(n, len(rows) - 1)
        for line in d:
            near = np.argpartition(line, m - 1)[:m] if m else np.zeros(0, np.int64)
            out.append(rows[near[np.lexsort((near, line[near]))]])
    return out


def distances(x: np.ndarray, metric: str):
    """A function (i, pool): distances of row i to the rows of a pool, summed as pairwise does; a shard of at most HELD rows looks them up."""
    if len(x) > HELD:
        return lambda i, pool: pairwise(x[pool], x[i], metric)
    held = np.stack([pairwise(x, one, metric) for one in x])
    return lambda i, pool: held[i][pool]


def spread(dist, i: int, pool: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a pool in order of distance to i: kept unless a kept one is nearer to it than i is, up to most; and those passed over."""
    d, shut, kept, at = dist(i, pool), np.zeros(len(pool), bool), [], 0
    while at < len(pool) and len(kept) < most:
        kept.append(at)
        shut |= dist(pool[at], pool) < d
        at += 1
        if len(kept) < most and at < len(pool):
            step = int(shut[at:].argmin())
            at = len(pool) if shut[at + step] else at + step
    passed = np.ones(at, bool)
    passed[kept] = False
    return pool[kept], pool[:at][passed]


def by_distance(dist, i: int, *pools: np.ndarray) -> np.ndarray:
    """All of some pools but i, each once, by distance to i and place."""
    pool = np.unique(np.concatenate(pools))
    pool = pool[pool != i]
    return pool[np.argsort(dist(i, pool), kind="stable")]


def reversed_lists(lists: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each of n places those whose list has it."""
    dst = np.concatenate([np.zeros(0, np.int64), *lists])
    order = np.argsort(dst, kind="stable")
    return np.split(np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order], np.searchsorted(dst[order], np.arange(1, n)))


def link(dist, start: list[np.ndarray], own: np.ndarray, n: int, most: int) -> list[np.ndarray]:
    """Neighbours of the nodes own after the heuristic, reverse edges, and the heuristic again where a node has too many."""
    out = [np.asarray(p, np.int64) if len(p) <= most else spread(dist, i, p, most)[0] for i, p in zip(own, start)]
    back = reversed_lists(out, n)
    for at, i in enumerate(own):
        both = by_distance(dist, i, out[at], own[back[i]])
        out[at] = both if len(both) <= most else spread(dist, i, both, most)[0]
    return out


def beams(near: np.ndarray, entries: np.ndarray, first: np.ndarray, ef: int, score) -> None:
    """Beam searches of many queries in step: each pops the nearest open node of its ef best until none is open.

    near: places of each node's neighbours, filled up with the node itself. first: estimates of the entries. score(rows,
    nodes, js): estimates of the neighbours js of the nodes that the queries rows have popped. A node that a beam turned
    away may come again by another edge.
    """
    c = len(entries)
    rows, taken = np.arange(c), np.zeros((c, len(near)), bool)
    taken[rows, entries] = True
    d, at, live = np.full((c, ef), np.inf), np.zeros((c, ef), np.int64), np.zeros((c, ef), bool)
    d[:, 0], at[:, 0], live[:, 0] = first, entries, True
    while True:
        todo = np.where(live, d, np.inf)
        best = todo.argmin(1)
        more = live[np.arange(len(rows)), best]
        if not more.all():
            rows, d, at, live, best = rows[more], d[more], at[more], live[more], best[more]
        if not len(rows):
            return
        each = np.arange(len(rows))
        nodes = at[each, best]
        live[each, best] = False
        js = near[nodes]
        e = score(rows, nodes, js)
        fresh = ~taken[rows[:, None], js] & (e < d.max(1)[:, None])
        r, j = np.nonzero(fresh)
        taken[rows[r], js[r, j]] = True
        d, at, live = np.concatenate([d, np.where(fresh, e, np.inf)], 1), np.concatenate([at, js], 1), np.concatenate([live, fresh], 1)
        keep = np.argpartition(d, ef - 1, axis=1)[:, :ef]
        d, at, live = (np.take_along_axis(x, keep, 1) for x in (d, at, live))


def padded_lists(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Neighbours as a matrix of n rows, filled up with the row's own place."""
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    size = np.bincount(src, minlength=n)
    out = np.repeat(np.arange(n)[:, None], max(1, size.max(initial=0)), 1)
    out[src, np.arange(len(src)) - np.repeat(np.cumsum(size) - size, size)] = dst
    return out


def by_shard(df: DataFrame, parts: int):
    """df grouped by shard, over so many partitions whatever their bytes: shards are small but take long, so small partitions mustn't be put together."""
    return df.repartition(parts, "shard").groupBy("shard")


def held_blocks(spark: SparkSession, queries: DataFrame) -> list:
    """All blocks of queries, each broadcast; one pass over the shards asks them all, so no graph is built or read once a block."""
    return [spark.sparkContext.broadcast(x) for x in scan.query_blocks(queries)]


def nearest_of(qids: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> pd.DataFrame:
    """The k least finite distances of each row of d (queries by places), ties to the smaller place."""
    bar = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if 0 < k < d.shape[1] else np.inf
    r, j = np.nonzero((d <= bar) & np.isfinite(d))
    order = np.lexsort((j, d[r, j], r))
    r, j = r[order], j[order]
    good = np.arange(len(r)) - np.searchsorted(r, r) < k
    r, j = r[good], j[good]
    return pd.DataFrame({"qid": qids[r], "vec_id": ids[j], "distance": d[r, j]})


# ---- layered graph ----


def levels(ids: np.ndarray, m: int, seed: int) -> np.ndarray:
    """floor(-ln(u) / ln(m)), u drawn by seed and id."""
    return np.floor(-np.log((K.drawn(seed, ids) + 1) / K.PRIME) / np.log(m)).astype(np.int64)


NODES = "shard int, vec_id long, level int, cluster_id int, code binary"
EDGES = "shard int, level int, src long, dst long"


@dataclass
class HnswIndex:
    """m links a node (2 m at the bottom), ef_construction candidates, bits a coordinate."""

    dim: int
    m: int = 16
    ef_construction: int = 200
    bits: int = 8
    metric: str = "l2"
    seed: int = 100
    shard: int = SHARD
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    centroids: DataFrame | None = None
    parts: int = 1

    def __post_init__(self):
        K.check_bits(self.bits)
        self.metric, self.m = metric_of(self.metric), min(self.m, 10_000)
        if self.m < 2:
            raise ValueError("m below 2")
        self.ef_construction = max(self.ef_construction, self.m)
        self.rotation = K.Rotation(self.dim)

    def build(self, data: DataFrame, centroids: DataFrame, fast: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> HnswIndex:
        """One graph a shard: exact candidates on each level, then links both ways. Repeated ids are an error."""
        scan.check_vectors(data, id_col, vec_col)
        importable(data.sparkSession)
        m, ef, metric, seed = self.m, self.ef_construction, self.metric, self.seed
        rows, self.parts = sharded(data, self.shard, id_col, vec_col)

        def graph(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("vec_id")
            ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(np.float64)
            if len(np.unique(ids)) < len(ids):
                raise ValueError("repeated ids")
            level, dist, out = levels(ids, m, seed), distances(x, metric), []
            for at in range(int(level.max()) + 1):
                own = np.flatnonzero(level >= at)
                near = link(dist, neighbours(x, ef, metric, own), own, len(ids), 2 * m if at == 0 else m)
                size = [len(js) for js in near]
                out.append(pd.DataFrame({"shard": pdf.shard.iloc[0], "level": at, "src": ids[np.repeat(own, size)], "dst": ids[np.concatenate(near)]}))
            return pd.concat(out)

        self.edges = by_shard(rows, self.parts).applyInPandas(graph, EDGES)
        self.centroids = centroids.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("centroid").cast("array<double>").alias("centroid"))
        found = list(cluster.centroid_blocks(self.centroids))
        held = data.sparkSession.sparkContext.broadcast((np.concatenate([i for i, _ in found]), self.rotation(np.concatenate([c for _, c in found]))))
        rotation, bits = self.rotation, self.bits

        def coded(parts):
            for pdf in parts:
                if not len(pdf):
                    continue
                own, c = held.value
                x = rotation(np.stack(pdf.embedding.to_numpy()).astype(np.float64))
                at = np.searchsorted(own, pdf.cluster_id.to_numpy())
                codes = K.encode(x, c[at], bits, metric, fast)
                record = [np.concatenate([a, b, [r[n] for r in (*codes.one.values(), *codes.ex.values())]]).astype("<f8").tobytes() for n, (a, b) in enumerate(zip(codes.sign, codes.code))]
                yield pd.DataFrame({"shard": pdf.shard, "vec_id": pdf.vec_id, "level": levels(pdf.vec_id.to_numpy(), m, seed), "cluster_id": pdf.cluster_id, "code": record})

        assigned = cluster.assign(rows, self.centroids)
        self.nodes = assigned.mapInPandas(coded, NODES)
        return self

    def search(self, queries: DataFrame, k: int, ef: int = 0) -> DataFrame:
        """(qid, rank, vec_id, distance) by full estimate; ef 0: max(k, 10). Only codes are read, no raw vector."""
        return scan.ranked(self._met(queries, k, ef, lambda qids, ids, full, width: nearest_of(qids, ids, full, k), scan.HITS), k)

    def candidates(self, queries: DataFrame, k: int, ef: int = 0) -> DataFrame:
        """(qid, vec_id, low, high): what the beams meet, without what can't be among the k nearest of a shard; metrics.bounded finishes the job."""

        def near(qids, ids, full, width):
            low, high = full - width, full + width
            bar = np.partition(high, k - 1, axis=1)[:, k - 1 : k] if 0 < k < len(ids) else np.inf
            r, j = np.nonzero(np.isfinite(full) & (low <= bar))
            return pd.DataFrame({"qid": qids[r], "vec_id": ids[j], "low": low[r, j], "high": high[r, j]})

        return self._met(queries, k, ef, near, "qid long, vec_id long, low double, high double")

    def _met(self, queries: DataFrame, k: int, ef: int, pick, schema: str) -> DataFrame:
        """What pick makes of the queries, ids, full estimates (infinite where the beam wasn't) and their certain errors, shard by shard."""
        if self.nodes is None:
            raise ValueError("the index isn't built")
        ef = max(ef or max(k, 10), k)
        found = list(cluster.centroid_blocks(self.centroids))
        cids, c = np.concatenate([i for i, _ in found]), self.rotation(np.concatenate([x for _, x in found]))
        rotation, bits, metric, size = self.rotation, self.bits, self.metric, self.rotation.size
        spark = self.nodes.sparkSession
        asked, held = held_blocks(spark, queries), spark.sparkContext.broadcast((cids, c))

        def walk(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            cids, c = held.value
            none = pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})
            if not len(nodes):
                return none
            nodes = nodes.sort_values("vec_id")
            ids, flat = nodes.vec_id.to_numpy(), np.stack([np.frombuffer(r, "<f8") for r in nodes.code])
            sign, f, n = flat[:, :size].copy(), flat[:, 2 * size :].T.copy(), len(nodes)
            total = (1 << (bits - 1)) * sign + flat[:, size : 2 * size]
            at, level = np.searchsorted(cids, nodes.cluster_id.to_numpy()), nodes.level.to_numpy()
            src, dst, on = np.searchsorted(ids, edges.src.to_numpy()), np.searchsorted(ids, edges.dst.to_numpy()), edges.level.to_numpy()
            near = [padded_lists(src[on == lv], dst[on == lv], n) for lv in range(int(level.max()) + 1)]
            entry, out = int(np.lexsort((ids, -level))[0]), []
            for qids, qs in (x.value for x in asked):
                turned = rotation(qs)
                for a in range(0, len(qids), step := max(1, STEP // n)):
                    q = turned[a : a + step]
                    each = np.arange(len(q))
                    codes, delta, vl = K.scalar_quantize(q, np.zeros(size), 4, fast=True)
                    small = codes * delta[:, None] + vl[:, None]  # the queries on 4 bits, for the one-bit estimate
                    g, away = (np.stack(y)[:, at] for y in zip(*[K.centre_terms(one, c, metric) for one in q]))
                    rough = f[0] + g + f[1] * (small @ sign.T - 0.5 * small.sum(1)[:, None])
                    now = np.full(len(q), entry)
                    for lv in range(int(level.max()), 0, -1):
                        while True:
                            js = near[lv][now]
                            e = rough[each[:, None], js]
                            to = js[each, e.argmin(1)]
                            if not (e.min(1) < rough[each, now]).any():
                                break
                            now = np.where(e.min(1) < rough[each, now], to, now)
                    met = np.zeros((len(q), n), bool)
                    met[each, now] = True

                    def score(rows, _, js, rough=rough, met=met):
                        met[rows[:, None], js] = True
                        return rough[rows[:, None], js]

                    beams(near[0], now, rough[each, now], ef, score)
                    full = f[3] + g + f[4] * (q @ total.T + K.query_terms(q, bits)[1][:, None])
                    out.append(pick(qids[a : a + step], ids, np.where(met, full, np.inf), K.certain(f[5], away, size)))
            return pd.concat(out) if out else none

        found = self.nodes.repartition(self.parts, "shard").groupBy("shard").cogroup(by_shard(self.edges, self.parts)).applyInPandas(walk, schema)
        return found if asked else spark.createDataFrame([], schema)

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        spark.createDataFrame([(self.dim, self.m, self.ef_construction, self.bits, self.metric, self.seed, self.shard)], "dim int, m int, ef int, bits int, metric string, seed int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        for name in ("nodes", "edges", "centroids"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HnswIndex:
        x = cls(*spark.read.parquet(f"{path}/meta").first())
        for name in ("nodes", "edges", "centroids"):
            setattr(x, name, spark.read.parquet(f"{path}/{name}"))
        x.parts = 2 * (1 + (x.nodes.agg(F.max("shard")).first()[0] or 0))
        return x


# ---- quantized graph ----


def relax(x: np.ndarray, i: int, kept: np.ndarray, passed: np.ndarray, degree: int, rest: np.ndarray) -> np.ndarray:
    """Exactly degree neighbours: passed ones whose cosine to every kept one is at most a bar, the lowest bar of [0.5, 1] in five halvings that fills them up, then others in hashed order."""
    if len(kept) < degree:
        passed = passed[~np.isin(passed, kept)]
        both, held = np.concatenate([kept, passed]), len(kept)
        away = x[both] - x[i]
        size = np.sqrt((away * away).sum(1))
        away = np.divide(away, size[:, None], out=np.zeros(away.shape), where=size[:, None] > 0)
        cosine = away[held:] @ away.T
        start = cosine[:, :held].max(axis=1, initial=-1.0)

        def fill(bar: float) -> np.ndarray:
            out, most, n = [], start, 0
            while held + len(out) < degree and n < len(passed):
                good = most[n:] <= bar + 1e-12
                step = int(good.argmax())
                if not good[step]:
                    break
                out.append(n + step)
                most = np.maximum(most, cosine[:, held + n + step])
                n += step + 1
            return np.concatenate([kept, passed[out]])

        lo, hi, got = 0.5, 1.0, fill(1.0)
        for _ in range(5 if len(got) >= degree else 0):
            middle = (lo + hi) / 2
            now = fill(middle)
            if len(now) >= degree:
                hi, got = middle, now
            else:
                lo = middle
        rest = rest[(rest != i) & ~np.isin(rest, got)]
        kept = np.concatenate([got, rest[np.sort(np.unique(rest, return_index=True)[1])]])
    return kept[:degree]


GRAPH = "shard int, src long, embedding array<double>, entry boolean, dst array<long>, sign binary, f_add array<double>, f_rescale array<double>"


@dataclass
class QuantizedGraph:
    """degree neighbours a vertex (a multiple of 32), each quantized on one bit about the vertex."""

    dim: int
    degree: int = 32
    metric: str = "l2"
    shard: int = SHARD
    seed: int = 42
    graph: DataFrame | None = None
    parts: int = 1

    def __post_init__(self):
        if self.degree % 32 or self.degree < 32:
            raise ValueError("the degree must be a multiple of 32")
        self.metric, self.rotation = metric_of(self.metric), K.Rotation(self.dim)

    def build(self, data: DataFrame, ef_construction: int = 200, rounds: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> QuantizedGraph:
        """rounds - 1 passes of pruning, reverse edges and fresh candidates, then one that fills every vertex to its degree."""
        if rounds < 2:
            raise ValueError("rounds below 2")
        scan.check_vectors(data, id_col, vec_col)
        importable(data.sparkSession)
        degree, metric, rotation, seed = self.degree, self.metric, self.rotation, self.seed

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("vec_id")
            ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(np.float64)
            if len(ids) <= degree:
                raise ValueError(f"a shard of {len(ids)} rows for degree {degree}")
            middle = x.mean(0)
            entry = int(np.lexsort((ids, ((x - middle) ** 2).sum(1)))[0])
            dist, pools = distances(x, metric), neighbours(x, min(ef_construction, 750), metric)
            now = [np.zeros(0, np.int64) for _ in ids]
            for turn in range(rounds):
                passed = [np.zeros(0, np.int64) for _ in ids]
                for i, pool in enumerate(pools):
                    pool = by_distance(dist, i, pool, now[i])
                    now[i], passed[i] = (pool, passed[i]) if len(pool) <= degree else spread(dist, i, pool, degree)
                back = reversed_lists(now, len(ids))
                for i in range(len(ids)):
                    both = by_distance(dist, i, now[i], back[i])
                    if len(both) > degree:
                        now[i], more = spread(dist, i, both, degree)
                        passed[i] = by_distance(dist, i, passed[i], more)
                    else:
                        now[i] = both
                if turn == rounds - 1:
                    rest = np.random.default_rng(seed).permutation(len(ids))[: 4 * degree]
                    rest = np.concatenate([rest, np.arange(min(len(ids), 2 * degree))])
                    now = [relax(x, i, js, passed[i][:300], degree, rest) for i, js in enumerate(now)]
                elif turn + 2 == rounds:
                    pools = [np.concatenate([js, *[now[j] for j in js]]) for js in now]
            turned, out = rotation(x), []
            for a in range(0, len(ids), 256):  # codes of all edges of 256 vertices at once
                js = np.stack(now[a : a + 256])
                c = np.repeat(turned[a : a + 256], degree, 0)
                r = turned[js.ravel()] - c
                sign = K.one_bit(r)
                f = K.factors(r, c, sign - 0.5, metric)
                out.append(pd.DataFrame({"shard": pdf.shard.iloc[0], "src": ids[a : a + 256], "embedding": list(x[a : a + 256]), "entry": np.arange(a, a + len(js)) == entry, "dst": list(ids[js]), "sign": K.pack_codes(sign.reshape(len(js), -1), 1), "f_add": list(f["f_add"].reshape(js.shape)), "f_rescale": list(f["f_rescale"].reshape(js.shape))}))
            return pd.concat(out)

        rows, self.parts = sharded(data, self.shard, id_col, vec_col)
        self.graph = by_shard(rows, self.parts).applyInPandas(build, GRAPH)
        return self

    @property
    def edges(self) -> DataFrame:
        return self.graph.select("shard", "src", F.explode("dst").alias("dst"))

    def search(self, queries: DataFrame, k: int, ef: int = 100) -> DataFrame:
        """(qid, rank, vec_id, distance): exact distances of the vertices that the beam meets: those that it pops and their neighbours."""
        if self.graph is None:
            raise ValueError("the index isn't built")
        ef, rotation, metric, size = max(ef, k), self.rotation, self.metric, self.rotation.size
        spark = self.graph.sparkSession
        asked = held_blocks(spark, queries)

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("src")
            ids, x, n = pdf.src.to_numpy(), np.stack(pdf.embedding.to_numpy()), len(pdf)
            near = np.searchsorted(ids, np.stack(pdf.dst.to_numpy()))
            sign = np.unpackbits(np.stack([np.frombuffer(r, np.uint8) for r in pdf.sign]), axis=1, bitorder="little").reshape(*near.shape, size)
            f_add, f_rescale = np.stack(pdf.f_add.to_numpy()), np.stack(pdf.f_rescale.to_numpy())
            norms, entry, out = (x * x).sum(1), int(np.flatnonzero(pdf.entry.to_numpy())[0]), []
            for qids, qs in (b.value for b in asked):
                turned = rotation(qs)
                for a in range(0, len(qids), step := max(1, STEP // n)):
                    q, rot = qs[a : a + step], turned[a : a + step]
                    k1, thin = -0.5 * rot.sum(1), rot.astype(np.float32)[:, :, None]
                    each, ip = np.arange(len(q)), q @ x.T
                    whole = (q * q).sum(1)[:, None] + norms - 2 * ip if metric == "l2" else 1 - ip
                    met = np.zeros((len(q), n), bool)
                    met[each, entry] = True

                    def score(rows, nodes, js, k1=k1, thin=thin, whole=whole, met=met):
                        met[rows[:, None], js] = True
                        g = whole[rows, nodes] if metric == "l2" else whole[rows, nodes] - 1
                        ip = (sign[nodes].astype(np.float32) @ thin[rows])[:, :, 0]
                        return f_add[nodes] + g[:, None] + f_rescale[nodes] * (ip + k1[rows, None])

                    beams(near, np.full(len(q), entry), np.full(len(q), -np.inf), ef, score)
                    for i in np.flatnonzero(met.sum(1) < k):  # a beam that ended early is filled up from what is left
                        met[i, np.flatnonzero(~met[i])[: 2 * k]] = True
                    whole[~met] = np.inf
                    bar = np.partition(whole, k - 1, axis=1)[:, k - 1 : k] if 0 < k < n else np.inf
                    r, j = np.nonzero(np.isfinite(whole) & (whole <= bar + 1e-9 * (1 + norms.max() + (q * q).sum(1)[:, None])))
                    exact = np.full(whole.shape, np.inf)
                    exact[r, j] = pairwise(x[j], q[r], metric)  # summed in one order, so that equal rows have equal distances
                    out.append(nearest_of(qids[a : a + step], ids, exact, k))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "distance": []})

        found = by_shard(self.graph, self.parts).applyInPandas(walk, scan.HITS)
        return scan.ranked(found if asked else spark.createDataFrame([], scan.HITS), k)

    def save(self, path: str) -> None:
        spark = self.graph.sparkSession
        spark.createDataFrame([(self.dim, self.degree, self.metric, self.shard, self.seed)], "dim int, degree int, metric string, shard int, seed int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        self.graph.write.mode("overwrite").parquet(f"{path}/graph")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantizedGraph:
        x = cls(*spark.read.parquet(f"{path}/meta").first())
        x.graph = spark.read.parquet(f"{path}/graph")
        x.parts = 2 * (1 + (x.graph.agg(F.max("shard")).first()[0] or 0))
        return x
