"""Every registered query against its SQL, by value."""

import duckdb
import pytest

from mailgrid.checks import registry
from mailgrid.checks.fixtures import TABLES


@pytest.fixture(scope="module")
def database(testdata):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{testdata}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, testdata, database, name):
    df = registry.QUERIES[name](spark, testdata)
    columns = sorted(df.columns)
    found = [tuple(r) for r in df.select(*columns).collect()]
    sql = registry.oracle_sql()[name]
    wanted = database.execute(
        f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})"
    ).fetchall()
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))
