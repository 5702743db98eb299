import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality
from tessella.llm._shared import crc32_mod

SCHEMA = "doc_id long, text string, score double, x int, own string"


def texts(n=1200):
    r = random.Random(11)
    words = ["".join(r.choices("abcdeinorst", k=r.randrange(2, 9))) for _ in range(500)]
    for i in range(n):
        t, good = r.choices(words, k=r.randrange(5, 200)), r.random() < 0.7
        if not good:
            kind = r.randrange(4)
            t = [" | ".join(t)] if kind == 0 else [w.upper() + "!!" for w in t] if kind == 1 else [w + "$$$" for w in t] if kind == 2 else [t[0]] * len(t)
        yield i, " ".join(t), int(good)


def test_held_out_accuracy(spark):
    rows = list(texts())
    docs = spark.createDataFrame([(i, t, 0.0, 1, "") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(10**6, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, crc32_mod("doc_id", 5) != 0)
    again = quality.fit(docs.repartition(7), labels.repartition(3), crc32_mod("doc_id", 5) != 0)
    assert model.pairs and all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))
    got = quality.score(docs, model).withColumn("out", crc32_mod("doc_id", 5) == 0).collect()
    want = {i: q for i, _, q in rows}
    out = [(r.score >= 0.3) == want[r.doc_id] for r in got if r.out]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean(out) > 0.97
    # the batch's bin additions are the sum of each table's entry
    x = quality.features_of(pa.array([t for _, t, _ in rows[:50]]))
    for n in range(50):
        bins = [int((c <= v).sum()) for c, v in zip(model.cuts, x[n])]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert model.score(x[n : n + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0, 1, ""), (2, "", 0.0, 1, ""), (None, " \n", 0.0, 1, ""), (2, "x" * 100_000, 0.0, 1, ""), (3, "\U0001f600 é", 0.0, 1, "")], SCHEMA)
    empty = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, quality int"))
    assert all(r.score == pytest.approx(0.75) for r in quality.score(docs, one).collect())
    assert quality.score(docs.limit(0), one).count() == 0
    assert np.isfinite(quality.features_of(pa.array([None, "", " ", "a", "A|B\n\n$"]))).all()
    bounded = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")), sample_rows=1)
    assert bounded.intercept == pytest.approx(np.log(2))


def test_whole_texts_count(spark):
    a = quality.features_of(pa.array(["word " * 50_000, "word " * 50_000 + "$$$ " * 50_000]))
    assert a[1, quality.FEATURES.index("bare")] == 0.5 and a[0, quality.FEATURES.index("bare")] == 0
