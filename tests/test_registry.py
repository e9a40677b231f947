"""Every registered query against its SQL, and the entry points."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from turnloom.functions.porter import stem
from turnloom.operators.rouge import UNSTEMMED
from turnloom.plans import registry, sql
from turnloom.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "none"
    return f"{v:.6g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in ORACLE:
        got = con.execute(ORACLE[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    spark.catalog.clearCache()


def test_stems_of_sql():
    """The SQL of the stemmer is written by pattern, the operator's by rule: they agree on random words with every ending."""
    rng = random.Random(1)
    ends = [*sql.STEP_2, *sql.STEP_3, *sql.STEP_4, "ed", "ing", "eed", "s", "sses", "ies", "y", "e", "ll", "ss", ""]
    words = {"".join(rng.choice("aeiouybtslzrwx") for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(5000)} | {"yttrium", "hopping", "agreed", "12ing"}
    c = duckdb.connect()
    c.execute("create table words as select unnest(?) as w", [sorted(words)])
    found = dict(c.execute("with " + sql.porter("p", "words").strip() + " select w, stem from p").fetchall())
    assert found == {w: stem(w) if len(w) > UNSTEMMED else w for w in words}


def test_aggregate_stems_words(spark, tmp_path):
    """arm_aggregate scored words as they stand; dialogues that differ in endings only are equal by their stems."""
    turns = [(i, t, role, f"{w} {'slowly' if t else 'happily'}") for i, w in enumerate(["walking", "walked", "walks"]) for t, role in enumerate(["assistant", "user"])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"note {i} of pain") for i in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["arm_aggregate"](spark, str(tmp_path))
    got = {(r.arm, r.metric): r.point_estimate for r in out.collect()}
    assert all(got[arm, m] == 1 for arm in ("retrieval", "successor") for m in ("rouge1", "rouge2", "rougeL"))
    assert got["half", "rouge1"] < 1
    spark.catalog.clearCache()


def test_sets_join_no_text(spark, sf_dir):
    """Training and test notes of retrieve_top1 were joined to their ids, which shuffles all texts where ids are not broadcast."""
    for notes in registry._sets(spark, sf_dir):
        plan = notes._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("Union") and plan.count("Join") == 1  # only what may be a copy is looked up
        assert "Join" not in plan.split("\n:- ")[1].split("\n+- ")[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
