"""Every corpus query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(values):
    norm = lambda v: round(v, 6) if isinstance(v, float) else None if v is None else str(v)
    return sorted((tuple(norm(v) for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, got.select(*cols).collect())) == rows(want)
