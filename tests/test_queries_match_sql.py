"""Every registered query with SQL gives DuckDB's rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from corvane.queries import ORACLES, QUERIES, flagship

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame) -> list:
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "none"
        v = v.item() if hasattr(v, "item") else v
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert frame.columns
    frame.count()


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0
