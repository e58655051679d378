"""Every registered query against its DuckDB oracle on the smallest scale."""

import os

import duckdb
import pytest

from conftest import SF_SMALL
from quoteflow.sources.tables import TABLES
from tools.oracle_check import norm

import __spark_entry__ as E

from quoteflow.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["pair", "opportunities", "line"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    key = lambda r: tuple("" if v is None else v for v in r)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=key)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    orows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=key)
    assert srows == orows
