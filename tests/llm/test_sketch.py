import hashlib
import random
import re

from pyspark.sql import functions as F

from tessella.llm import sketch

SCHEMA = "doc_id long, text string, part string, guest int, id int"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for n, r in enumerate(rows):
        t, x = r[1] or "", rows[(n + 1) % len(rows)][1] or ""
        yield r[0], t, t[: len(t) - len(t) // 2] + x[: len(t) // 2], x


def test_edits_and_estimates(spark):
    r = random.Random(2)
    vocab = ["Über", "été", "\U0001f600"] + [f"w{i}" for i in range(500)]
    rows = [(i * 3 - 40, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 9, 30, 300, 3000]))), "", 0, 0) for i in range(150)]
    rows += [(None, "null id " * 9, "", 0, 0), (8, None, "", 0, 0), (8, "again", "", 0, 0), (8, "again", "", 0, 0), (10**9, "long " * 300_000, "", 0, 0)]
    rows.append((rows[20][0] + 1, rows[20][1], "", 0, 0))
    got = sketch.fingerprint(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = sorted((i, len(t), hashlib.sha256(e.encode()).hexdigest()) if i is not None else (-(10**9), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in expected(rows))
    assert sorted((x.id if x.id is not None else -(10**9), x.n_chars, x.edited_sha256) for x in got) == want
    by = {(x.id, x.n_chars, x.edited_sha256): x for x in got}
    off = []
    for i, t, e, n in expected(rows):
        if i == 8:
            continue  # repeated
        x, a, b, c = by[i, len(t), hashlib.sha256(e.encode()).hexdigest()], shingles(t), shingles(e), shingles(n)
        assert x.edited_fingerprint == sketch.encode(sketch.sketches(__import__("pyarrow").array([e]))[0])
        for near, resembles, other in ((x.near_edited, x.resembles_edited, b), (x.near_next, x.resembles_next, c)):
            off.append(abs(near - (len(a & other) / len(a) if a else 1)))
            off.append(abs(resembles - (len(a & other) / len(a | other) if a | other else 1)))
            if len(a) <= 16 and len(other) <= 16:
                assert off[-1] < 1e-9 and off[-2] < 1e-9
            if min(len(a), len(other)) > 1000:
                assert max(off[-2:]) < 0.2
    assert sum(off) / len(off) < 0.06


def test_sketches_merge():
    import pyarrow as pa

    r = random.Random(4)
    a, b = (" ".join(r.choices([f"w{i}" for i in range(300)], k=2000)) for _ in range(2))
    one, two = sketch.sketches(pa.array([a, b]))
    both = sketch.cut(__import__("numpy").concatenate([one[0], two[0]]))
    assert sketch.encode(sketch.merge(one, two)) == "~" + sketch.encode(both)[1:]
    assert sketch.decode(sketch.encode(one))[0].tolist() == one[0].tolist()
    assert sketch.compare(one, sketch.merge(one, two))[0] == 1.0


def test_ranges_and_empty_tables(spark):
    assert sketch.fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0
    one = sketch.fingerprint(spark.createDataFrame([(1, "a b c d e f", "", 0, 0)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    cuts = list(range(0, 5000, 7))
    df = spark.range(-5, 5100).select("id", sketch._between(F.col("id"), cuts).alias("n"))
    assert all(r.n == sum(c <= r.id for c in cuts) for r in df.collect()[::13])
