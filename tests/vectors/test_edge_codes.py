from tessella.plans.queries import _edge_codes


def test_large_ids_stay_whole(spark):
    rows = [(5, 1_000_003, [1.0, 0.5], [0.0, 0.0]), (2_000_007, 3, [0.5, 1.0], [0.0, 0.1]), (1 << 40, 1 << 41, [0.2, 0.1], [1.0, 0.0])]
    got = _edge_codes(spark.createDataFrame(rows, "src long, dst long, v array<double>, c array<double>")).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted((a, b) for a, b, *_ in rows)
