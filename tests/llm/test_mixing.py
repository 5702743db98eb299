from pyspark.sql import functions as F

from tessella.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def fill(sources, total, most):
    """Water-filling by repeated clamping, on a dict of source -> (size, weight)."""
    clamped = set()
    while True:
        rest = total - sum(most * sources[s][0] for s in clamped)
        weight = sum(w for s, (n, w) in sources.items() if s not in clamped and n > 0)
        over = {s for s, (n, w) in sources.items() if s not in clamped and n > 0 and weight and most * n * weight < w * rest}
        if not over:
            return {s: most * n if s in clamped else (w * rest / weight if n and weight else 0) for s, (n, w) in sources.items()}
        clamped |= over


def test_water_filling(spark):
    for total in (None, 10, 100_000, 5_000_000):
        sizes = {f"s{i}": ((i * 7919) % 1000 * (100 if i % 3 else 1), 1 + i % 4) for i in range(40)}
        df = spark.createDataFrame([(s, n, w) for s, (n, w) in sizes.items()], "source string, size long, weight long")
        got = {r.source: r.target for r in mixing.water_fill(df, total).collect()}
        want = fill(sizes, sum(n for n, _ in sizes.values()) if total is None else total, 3)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_targets_are_met_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), f"s{min(i % 7, 3)}" if i % 11 else None, 0, "") for i in range(3000)]
    rows += [(None, "a b", "s0", 0, ""), (5, "x y z", "s1", 0, ""), (5, "x y z", "s1", 0, ""), (6, None, "s2", 0, ""), (7, " \n", "only empty", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).select("doc_id", "source", "text", "mix_.*").collect()
    again = mixing.mix(df.repartition(5)).select("doc_id", "source", "text", "mix_.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        size = sum(len((r.text or "").split()) for r in own)
        assert {r.source_size for r in own} == {size} and all(r.size == len((r.text or "").split()) and 0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 50
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6


def test_weights_go_by_code_point(spark):
    names = ["b", "a", "Z", "é", "", None, "\U0001f600", "￿"]
    got = {r.source: r.weight for r in mixing.cyclic_weights(spark.createDataFrame([(x,) for x in names], "source string")).collect()}
    order = sorted((x for x in names if x is not None)) + [None]
    assert got == {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}


def test_many_sources_and_empty_table(spark):
    old, mixing.FEW = mixing.FEW, 3
    try:
        df = spark.createDataFrame([(i, "w w w", f"s{i % 9}", 0, "") for i in range(90)], SCHEMA)
        assert df.count() == mixing.mix(df).count() == 90
    finally:
        mixing.FEW = old
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    weights = spark.createDataFrame([("s0", 1), ("s1", 3)], "source string, weight int")
    got = mixing.plan(df.where(F.col("source") < "s2"), weights, total=40).collect()
    assert {r.source: r.target for r in got} == {"s0": 10.0, "s1": 30.0}
