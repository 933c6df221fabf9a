"""Every registered query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from codeloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    want = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert key(got.select(*columns).collect()) == key(want.fetchall())


def test_entry_point():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
