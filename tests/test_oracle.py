"""Every registered query against its DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from potluck.oracle_sql import QUERIES as SQL
from potluck.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple("" if x is None else x for x in r))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["group_id", "month", "category", "amount"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    got = _rows(QUERIES[name](spark, SF).toPandas())
    want = _rows(con.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
