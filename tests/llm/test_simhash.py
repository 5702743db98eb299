import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash

from tessella.llm import simhash
from tessella.llm._shared import reliable
from tessella.llm.components import components

SCHEMA = "doc_id long, text string, key string, n int, u int"


def brute_fp(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def roots(nodes, pairs):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def texts():
    r = random.Random(5)
    vocab = [f"w{i}é" for i in range(60)] + ["The", "AND", "Ünd"]
    out = [None, "", " \t\n", "one", "One  two", "a\x0bb\x0cc"]
    for _ in range(60):
        base = r.choices(vocab, k=r.choice([3, 4, 40, 400]))
        out.append(" ".join(base))
        if r.random() < 0.6:
            base[r.randrange(len(base))] = "edited"
            out.append("\n".join(base))
        if r.random() < 0.4:
            out.append(out[-1])
    out.append(" ".join(r.choices(vocab, k=60_000)))
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts())]
    got = {r.id: r for r in simhash.classes(spark.createDataFrame(rows, SCHEMA), k=3).collect()}
    fp = {i: brute_fp(t, 3) for i, t, *_ in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fp
    near = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
    assert {i: r.component for i, r in got.items()} == roots(fp, near)


def test_crowded_keys_go_by_midpoints(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    some = {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(200)}
    df = spark.createDataFrame([(x - (1 << 64) * (x >> 63),) for x in some], "fp long")
    old, simhash.CROWD = simhash.CROWD, 8
    try:
        got = {m: {(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, m).collect()} for m in (2, 3)}
    finally:
        simhash.CROWD = old
    got[4] = {(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, 3).collect()}
    for m, found in got.items():
        assert {frozenset(p) for p in found} == {frozenset(p) for p in itertools.combinations(some, 2) if (p[0] ^ p[1]).bit_count() <= min(m, 3)}


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d", "", 1, 1), (7, "a b c d", "", 1, 1), (7, "a b c d", "", 1, 1), (None, "zz yy", "", 1, 1)]
    got = sorted((r.id or -1, r.component or -1) for r in simhash.classes(spark.createDataFrame(rows, SCHEMA), k=3).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]
    assert simhash.classes(spark.createDataFrame([], SCHEMA), k=3).count() == 0


def test_components_of_chains_and_hubs(spark):
    r = random.Random(3)
    ids = r.sample(range(-(10**12), 10**12), 300)
    pairs = list(zip(ids[:120], ids[1:120])) + [(ids[150], x) for x in ids[151:260]] + [(ids[270], ids[270])]
    got = dict(components(reliable(spark.createDataFrame(pairs, "u long, v long"))).collect())
    want = roots({x for p in pairs for x in p} - {ids[270]}, pairs[:-1])
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_workers_hold_little_beside_a_large_batch(spark, monkeypatch):
    docs, taken = spark.createDataFrame([(1, "a word", "", 0, 0)], SCHEMA), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f) or real(self, f, schema))
    simhash.fingerprints(docs, k=3)
    texts = [" ".join(random.Random(i).choices(["a", "word", "of", "texts"], k=2_000)) for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(300)), "text": texts})
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in taken[0](iter([batch]))) == 300
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 << 20
