"""The pipeline against its stages' plain rules, and the guard of the entry module."""

from __future__ import annotations

import os
import subprocess
import sys

import corpus_pipeline
from tests.llm.helpers import SCHEMA, contaminated, near_groups
from tests.llm.test_rows import language_rows, plain_mix, words
from turnloom.llm import langid, mixing, secrets
from turnloom.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

BENCH = [(1, " ".join(f"bench{i}" for i in range(20)))]


def corpus():
    rows = language_rows(80, 11)
    say = rows[3][1]
    rows += [(200, None, "xa", "a", 0), (201, "123 456", "xa", "a", 0), (202, say, "xa", None, 0), (203, rows[5][1] + " katori", rows[5][2], "b", 0)]
    rows += [(204, rows[7][1] + " " + BENCH[0][1], rows[7][2], "b", 0), (205, rows[9][1] + " password=abcdefghijklmnop", rows[9][2], "a", 0)]
    return [(i, t, lang, s if s != "s" else "abc"[i % 3], 0 if t is None else len(t)) for i, t, lang, s, _ in rows]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.fit(docs, F.lit(True))
    known = {r.doc_id for r in langid.predictions(docs, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r[0] for r in rows} - known >= {200, 201}
    left = [r for r in rows if r[0] in known]
    groups = near_groups(left)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    found = contaminated(left, BENCH)
    left = [r for r in left if not (found[r[0]][1] and 20 * found[r[0]][1] >= found[r[0]][0])]
    left = [(i, secrets.redacted(t), lang, s, 0) for i, t, lang, s, _ in left]
    want, _, _ = plain_mix(left)
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(left, SCHEMA)).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in left}
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == sorted((*x, taken[x[0]]) for x in want if taken[x[0]])
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) and r["size"] == len(words(r.text)) for r in got)
    assert not {200, 201, 202, 203, 204} & {r.doc_id for r in got}


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "1 as comp", "'x' as `__h`", "2.5 as score")
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns


def test_registration():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)


def test_the_library_does_without(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(f"cp -r {here}/turnloom {here}/__spark_entry__.py {tmp_path} && rm -r {tmp_path}/turnloom/llm", shell=True, check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
