import hashlib
import random
import re
from collections import Counter

from tessella.llm import phrases

SCHEMA = "doc_id long, text string, k1 string, n int, anchor string"


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for (i, *_), w in zip(rows, split):
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone |= set(range(a, a + window))
        yield i, len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Ä", "\U0001f600", "x y"]
    passages = [r.choices(vocab, k=r.choice([34, 35, 36, 60, 120])) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "that " * 34), (3, "that " * 35), (4, "one " * 90), (5, " \n\t"), (None, "null id"), (7, "a b " * 40)]
    for i in range(120):
        w = []
        for _ in range(r.randrange(4)):
            w += r.choices(vocab, k=r.randrange(50))
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randrange(max(1, len(p) - 34))
                w += p[a : a + r.choice([35, 36, 50, 200])]
        rows.append((i + 10, r.choice([" ", "\n", " \x0b "]).join(w)))
        if r.random() < 0.3:
            rows.append((i + 500, rows[-1][1]))
        if r.random() < 0.3 and w:
            w[r.randrange(len(w))] = "edit"
            rows.append((i + 900, "  ".join(w)))
    rows.append((5000, " ".join(r.choices(vocab, k=40_000))))
    rows += [(10, "again"), (10, "again")]
    return [(i, t, "", 0, "") for i, t in rows]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_against_brute_force(spark):
    rows = corpus()
    got = phrases.cut(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, 35)))


def test_hot_anchors_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 3)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 100)
    rows = corpus(2)
    got = phrases.cut(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, 35)))


def test_texts_and_empty_table(spark):
    assert phrases.cut(spark.createDataFrame([], SCHEMA)).count() == 0
    p = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"x y {p} z", "", 0, ""), (2, f"{p}  q", "k", 1, "t"), (3, None, "", 0, ""), (4, "as  it\nis", "", 0, "")]
    got = {r.doc_id: r.text for r in phrases.cut_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "x y z", 2: "q", 3: None, 4: "as  it\nis"}


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    rows = corpus(3)[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    assert any(r[2] for r in brute(rows, 35))
    real = phrases.automaton
    segments = ["a b c d e", "z a b c d", "q q q q q q"]
    assert phrases.locate(segments, [1, 1, 1], 3) == [[(0, 4)], [(1, 5)], [(0, 6)]]
    monkeypatch.setattr(phrases, "MACHINE", 1)
    assert phrases.locate(segments, [1, 1, 1], 3) == [[(0, 4)], [(1, 5)], [(0, 6)]]
    monkeypatch.setattr(phrases, "automaton", lambda _: real(["never in a text"]))
    assert phrases.locate(segments, [1, 1, 1], 3) == [[], [], []]
    assert phrases.cut(df).count() == len(rows)
