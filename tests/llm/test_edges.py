"""What every stage and operator does with odd tables: columns with the names that the operators use
inside, null ids, repeated rows, no rows, and a text of a megabyte."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA
from turnloom.llm import align, decontam, langid, licences, lmscore, minhash, mixing, secrets, suffix, toxicity
from turnloom.llm.common import BATCH_BYTES, small_batches

NAMES = "__tl_h __tl_words __tl_hit __tl_size __tl_source __tl_s ___tl_h id tie h g n root comp digest key leaf doc p spans full threshold rid kind"


def corpus():
    rng = random.Random(1)
    say = lambda k: " ".join(rng.choice(["ka", "to", "ri", "mula", "nor", "est", "über", "4"]) for _ in range(k))
    rows = [(i, say(20 + i), "xa" if i % 2 else "yo", ["a", "b", None][i % 3], 0) for i in range(12)]
    rows += [(None, rows[3][1], "xa", None, None), (None, None, None, None, None), (20, "", None, "a", 0), (21, say(250_000), "yo", "b", 0)]
    return rows + [rows[2], rows[2], rows[13]]


OPERATORS = {
    "minhash": minhash.near_duplicates,
    "mixing": mixing.mix,
    "suffix": suffix.remove_repeats,
    "secrets": secrets.scan,
    "langid": lambda d: langid.predictions(d, langid.fit(d, F.lit(True))),
    "lmscore": lmscore.scores,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int"), F.lit(True))),
    "licences": licences.scan,
    "align": align.tokens,
    "decontam": lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([(1, "ka to ri"), (None, "mula")], "item_id long, text string")),
}
#: Those that hand on the rows of docs, all columns.
STAGES = {
    "langid": lambda d: langid.accepted(d, langid.fit(d, F.lit(True)), 0.5),
    "minhash": minhash.deduplicated,
    "decontam": lambda d: decontam.clean(d, d.sparkSession.createDataFrame([(1, "no such words")], "item_id long, text string")),
    "secrets": secrets.redact,
    "mixing": mixing.mixed,
}


def odd(df):
    return df.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(NAMES.split())])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, name):
    run = OPERATORS[name]
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plain = run(docs)
    rows = sorted(map(str, plain.collect()))
    assert len(rows) == len(corpus())
    clashing = run(odd(docs))
    assert clashing.schema == plain.schema and sorted(map(str, clashing.collect())) == rows
    assert run(odd(docs.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_hand_on_columns_that_clash(spark, name):
    run = STAGES[name]
    docs = spark.createDataFrame(corpus(), SCHEMA)
    want = sorted(map(str, run(docs).collect()))
    out = run(odd(docs))
    extra = NAMES.split()
    got = out.collect()
    assert all(r[c] == i for r in got for i, c in enumerate(extra))
    assert sorted(str(r) for r in out.drop(*extra).collect()) == want and want
    assert run(odd(docs.limit(0))).count() == 0


def test_batches_are_bounded_in_bytes(spark):
    small_batches(spark)
    texts = spark.range(40).coalesce(1).select(F.expr("repeat('x', 1000000)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 3 and max(found) < BATCH_BYTES + 2_000_000
