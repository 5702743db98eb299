import itertools
import random

import pyarrow as pa

import corpus_pipeline
from tessella.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x and y) and 5 * len(x & y) >= 4 * len(x | y)


def edited():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for n in [5, 9, 30, 60, 100, 200] * 6:
        base = r.choices(vocab, k=n) + ["all", "rights", "of", "this", "text", "are", "held"]
        out.append(" ".join(base))
        for changes in (1, 2, 4):
            new = base.copy()
            for _ in range(changes):
                new[r.randrange(len(new))] = "edited"
            out.append(" ".join(new))
    return out


def component_count(texts, linked):
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if linked(texts[a], texts[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in range(len(texts)) if find(i) == i}


def test_every_pair_at_four_fifths_is_merged(spark):
    texts = edited()
    old, jaccard.HOT = jaccard.HOT, 8
    try:
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
        got = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    finally:
        jaccard.HOT = old
    assert got == component_count(texts, similar) and len(got) < len(texts) - 30


def test_a_shingle_of_many_sets_is_in_no_prefix_of_sets_with_enough_others(spark, monkeypatch):
    common = [f"c{i}" for i in range(44)]  # 40 of about 100 shingles of each set
    rows = [(i, " ".join(common + [f"d{i}x{j}" for j in range(60)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = jaccard.names_of(*jaccard.sets_of(pa.array([t for _, t in rows]), 5))
    named = spark.createDataFrame([(x, 100, i) for i, x in enumerate(names)], "name long, n long, component long")
    kept, table = [], jaccard.table
    monkeypatch.setattr(jaccard, "table", lambda df: kept.append(table(df)) or kept[-1])
    assert jaccard.joined(docs, named, 5).count() == 0
    assert max([r["count"] for r in kept[0].groupBy("token").count().collect()], default=0) < jaccard.HOT
