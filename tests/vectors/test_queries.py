import duckdb
import pytest

import __spark_entry__
from tessella.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(map(str, (norm(tuple(r)) for r in rows.select(*columns).collect())))
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
        found = con.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(str(norm(tuple(r[i] for i in at))) for r in found.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() == 100 and set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
