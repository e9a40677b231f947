"""Queries with SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from turnloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    got = con.execute(ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()
