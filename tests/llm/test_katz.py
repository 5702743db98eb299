import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import katz

SCHEMA = "doc_id long, text string, id int, held string, u int"


class Brute:
    def __init__(self, rows):
        self.tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t, *_ in rows]
        self.train = [x for x, (i, *_) in zip(self.tokens, rows) if i is None or i % 7 != 2]
        self.c = Counter(w for x in self.train for w in x)
        self.pairs = Counter((u, v) for x in self.train for u, v in zip([0, *x], x))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.context = Counter()
        self.after = {}
        for (u, v), n in self.pairs.items():
            self.context[u] += n
            self.after.setdefault(u, []).append(v)
        self.d1, self.d2 = self.lost(self.c), self.lost(self.pairs)
        gone = sum(self.loss(n, self.d1) for n in self.c.values())
        self.unknown = gone / self.n if self.n else 1.0

    def lost(self, counts):
        n = Counter(counts.values())
        out, k = [0.5] * 5, 5
        rest = 6 * n[6] / n[1] if n[1] else 1
        for r in range(1, 6):
            if n[r] and n[r + 1] and rest < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                if 0.01 < d < 0.9999:
                    out[r - 1] = r * (1 - d)
        assert k == katz.K
        return out

    def loss(self, c, lost):
        return lost[c - 1] if c <= 5 else katz.TAIL

    def word(self, v):
        return (self.c[v] - self.loss(self.c[v], self.d1)) / self.n if self.c[v] else self.unknown

    def p(self, u, v):
        if not self.context[u]:
            return self.word(v)
        if self.pairs[u, v]:
            return (self.pairs[u, v] - self.loss(self.pairs[u, v], self.d2)) / self.context[u]
        left = sum(self.loss(self.pairs[u, x], self.d2) for x in self.after[u]) / self.context[u]
        return left / (1 - sum(self.word(x) for x in self.after[u])) * self.word(v)

    def score(self, x):
        return sum(math.log10(self.p(u, v)) for u, v in zip([0, *x], x))

    def base(self, x):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in x)


def corpus(n=150):
    r = random.Random(3)
    vocab = ["the", "The", "of", "été"] * 40 + [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 5, 60, 200]))), 0, "", 0) for i in range(n)]
    return rows + [(None, "null id the", 0, "", 0), (9, None, 0, "", 0), (9, "the of\n\tof", 0, "", 0), (9, "the of\n\tof", 0, "", 0), (2, "w1 unseen", 0, "", 0), (n + 1, "the " * 20_000, 0, "", 0)]


@pytest.mark.parametrize("group", [1_000_000, 700])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(katz, "GROUP", group)
    rows = corpus()
    model = Brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[-1], 6))
    got = sorted(map(tuple, katz.score(df, F.pmod("doc_id", F.lit(7)) == 2).collect()), key=key)
    want = sorted(((i, i is not None and i % 7 == 2, len(x), sum(model.c[w] > 0 for w in x), model.n, model.base(x), model.score(x)) for (i, *_), x in zip(rows, model.tokens)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    for u in [0, "the", "w1", "été"]:
        assert sum(model.p(u, v) for v in model.c) + model.p(u, "never seen") == pytest.approx(1, abs=1e-9)


def test_nothing_to_train_on_and_empty(spark):
    got = katz.score(spark.createDataFrame([(2, "a b", 0, "", 0)], SCHEMA), F.pmod("doc_id", F.lit(7)) == 2).first()
    assert (got.train_tokens, got.n_tokens, got.n_known, got.base_score, got.score) == (0, 3, 0, 0.0, 0.0)
    assert katz.score(spark.createDataFrame([], SCHEMA), F.pmod("doc_id", F.lit(7)) == 2).count() == 0
