"""Every query that has an SQL twin, on the smallest tables."""

import duckdb
import pytest

from check import TABLES, compare
from sitelattice.suite import load_all

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, small, name):
    status, _, msg = compare(spark, con, name, QUERIES[name], ORACLES[name], small)
    assert status == "ok", msg


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
