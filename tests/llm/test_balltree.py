import numpy as np
from pyspark.sql import functions as F

from tessella.llm import balltree


def brute(rows, k):
    out = {}
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        own = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in own[:k]]
    return out


def ask(spark, rows, shard, block):
    df = balltree.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(3)))
    got = {}
    for r in sorted(balltree.top_k(df, F.pmod("id", F.lit(50)) == 0, 5, shard, block).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_against_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=8).round(1).astype(float).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[i][1]) for i in range(0, 300, 3)]  # ties
    assert ask(spark, rows, 300, 7) == brute(rows, 5)
    assert ask(spark, rows, 10_000, 512) == brute(rows, 5)


def test_unusable_ragged_and_huge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [None, 1.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 0.0]), (3, [1.0]), (None, [1.0, 1.0])]
    rows += [(4, [-3.5, 2.0]), (5, [1e15, -1.0]), (150, [1e9, 1e9]), (6, [1e9, -1e9]), (200, []), (7, [])]
    got = ask(spark, rows, 4, 2)
    want = {q: [(i, max(-balltree.LONG, min(balltree.LONG, s))) for i, s in x] for q, x in brute(rows, 5).items() if x}
    assert got == want


def test_fewer_candidates_and_empty(spark):
    assert ask(spark, [(0, [1.0])], 10, 10) == {}
    assert ask(spark, [], 10, 10) == {}
