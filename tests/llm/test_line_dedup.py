import random
import re

from tessella.llm import line_dedup

SCHEMA = "doc_id long, text string, lines_ string, _gone int, _line1 string, gone string, row int, doc int, t1 string"
ALL = 1 << 30


def n_words(x):
    return len(re.findall(r"[^\x20\x09-\x0D]+", x))


def diff(a, b, i=0, j=0):
    """Patience diff by its definition: equal ends, the longest ascending chain of lines single on both sides (ties: the latest), and the same between."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *diff(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*diff(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    single = [(p, b.index(x)) for p, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    best = []
    for n, (_, q) in enumerate(single):
        best.append(1 + max([best[m] for m in range(n) if single[m][1] < q], default=0))
    chain = []
    for n in range(len(single) - 1, -1, -1):
        if (not chain and best[n] == max(best)) or (chain and best[n] == best[chain[0]] - 1 and single[n][1] < single[chain[0]][1]):
            chain.insert(0, n)
    out, edges = [], [(-1, -1), *[single[n] for n in chain], (len(a), len(b))]
    if not chain:
        return []
    for (p, q), (r, t) in zip(edges, edges[1:]):
        out += diff(a[p + 1 : r], b[q + 1 : t], i + p + 1, j + q + 1)
        if r < len(a):
            out.append((i + r, j + t))
    return out


def test_patience():
    r = random.Random(0)
    for n in range(400):
        a, b = (r.choices("abcdefgh"[: 2 + n % 7], k=r.randrange(12)) for _ in range(2))
        assert line_dedup.patience(a, b) == diff(a, b)
    assert line_dedup.patience(list("abcd"), list("xbyd")) == [(1, 1), (3, 3)]


def brute(rows, rare, min_words=3):
    """Every later text against every earlier one that shares a line of at most rare texts, or is the first to hold one, or to hold it as often; over all lines of both."""
    least = {}
    for i, t, *_ in rows:
        if t is not None:
            least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    docs = sorted(least, key=lambda t: least[t])
    lines = [t.split("\n") for t in docs]
    holders = {}
    for d, own in enumerate(lines):
        for x in {x for x in own if n_words(x)}:
            holders.setdefault(x, []).append(d)
    peer = {}
    for d, own in enumerate(lines):
        for x in set(own):
            peer.setdefault((x, own.count(x)), d)
    cut = {}
    for d, own in enumerate(lines):
        full = [(p, x) for p, x in enumerate(own) if n_words(x)]
        number = {p: n for n, (p, _) in enumerate(full)}
        gone = set()
        for e in range(d):
            common = {x for _, x in full if e in holders[x]}
            if not any(holders[x][0] == e or len(holders[x]) <= rare or peer[x, own.count(x)] == e for x in common):
                continue
            b, block = [(p, x) for p, x in full if x in common], []
            for p in [*(b[j][0] for _, j in diff([x for x in lines[e] if x in common], [x for _, x in b])), None]:
                if p is None or not block or number[p] != number[block[-1]] + 1:
                    if sum(n_words(own[q]) for q in block) >= min_words:
                        gone |= set(block)
                    block = []
                block.append(p)
        cut[docs[d]] = gone
    for i, t, *_ in rows:
        if t is None:
            yield i, None, 0, 0
            continue
        own, gone = t.split("\n"), cut[t]
        if (i is None, i or 0) != least[t] and n_words(t) >= min_words:
            gone = {p for p, x in enumerate(own) if n_words(x)}
        yield i, "\n".join(x for p, x in enumerate(own) if p not in gone), len(own), len(gone)


def same(spark, rows, rare=line_dedup.RARE):
    rows = [(*r, "a", 1, "b", "c", 2, 3, "d") for r in rows]
    got = line_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), rare=rare)
    assert got.columns == [*SCHEMA.replace(",", "").split()[::2], "lines__"]
    got = got.collect()
    assert all((*r[2:9],) == ("a", 1, "b", "c", 2, 3, "d") for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", *r[2:])
    got = sorted(((r.doc_id, r.text, *r.lines__) for r in got), key=key)
    assert got == sorted(brute(rows, rare), key=key)
    return {r[0]: r[1] for r in got}


def corpus(seed):
    r = random.Random(seed)
    pool = [f"line {i} of the pool" for i in range(30)] + ["x", "a b", "Les.", "All rights reserved.", " ", "", "\t\x0b"]
    rows = [(i * 2, "\n".join(r.choices(pool, k=r.randrange(9)))) for i in range(80)]
    # distinct ids only, but for repeated rows: two texts under one id are ordered by hash
    rows += [(201 + i, "\n".join([*(f"own {i} {j}" for j in range(3)), "boiler plate line", "", *pool[i : i + 4]])) for i in range(20)]
    rows += [(None, rows[3][1]), (500, None), (501, ""), (502, "same\n" * 50), (503, "same\n" * 50), (504, "same\n" * 49 + "other"), (rows[5][0], rows[5][1]), (rows[5][0], rows[5][1]), (None, None)]
    return rows + [(600 + i, rows[r.randrange(100)][1]) for i in range(20)]


def test_against_all_pairs(spark):
    same(spark, corpus(7), ALL)


def test_against_brute_force_with_the_choice_of_pairs(spark):
    for rare in (0, 4):
        same(spark, corpus(8), rare)


def test_a_copy_loses_every_line_however_frequent(spark):
    holders = [(i, "Bb.\nAa.") for i in range(6)]
    got = same(spark, [*[(i, f"{t}\nown {i} of text") for i, t in holders], (10, "Aa.\nBb.\nCc."), (11, "Aa.\nBb.\nCc.")])
    assert got[11] == ""
    texts = ["Les.", *(f"own {i} text\nLes." for i in range(6)), "p q r s\nLes.\nt u v w", "p q r s\nLes.\nt u v w\nmore"]
    assert same(spark, list(enumerate(texts)))[8] == "more"


def test_texts_under_one_id(spark):
    rows = [(1, "a b c d\ne f g h"), (1, "e f g h\na b c d"), (1, "a b c d\ne f g h")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and sum(r.lines_.n_removed == 0 for r in got) in (1, 2) and sum(r.lines_.n_removed for r in got) >= 1


def test_very_long_text_and_empty_table(spark):
    long = "\n".join(f"line {i} of many" for i in range(60_000))
    rows = [(1, long), (2, "head\n" + long), (3, "x" * 2_000_000)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2].text, got[2].lines_.n_removed, got[1].text == long, got[3].lines_.n_lines) == ("head", 60_000, True, 1)
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
