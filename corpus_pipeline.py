"""Corpus pipeline: STAGES applied one after another to documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  Stages take columns of any further names along; an
empty table goes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import decontam, langid, minhash, mixing, secrets
from turnloom.llm.common import discard, materialise, small_batches, table

#: Posterior below which the language of a text counts as unknown.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts, texts without letters and those that no language explains best go.

    Trees are learned from labelled rows of docs; of equal code lengths the first language counts.  Rows are
    judged one by one by their text, so null ids and repeated rows need no rule."""
    small_batches(spark)
    return langid.accepted(docs, langid.fit(docs, F.lit(True)), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: of the least doc_id and, of rows that share it, of the least text
    hash; of equal rows one.  Documents without words or without doc_id stay."""
    small_batches(spark)
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate; null and wordless texts stay.  Items without an id count like
    others."""
    small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced and n_chars brought up to date; null texts and the other columns are as before."""
    small_batches(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each.  A null source is a source; rows that share a
    doc_id are taken or left together; empty texts are never taken."""
    small_batches(spark)
    return mixing.mixed(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", hide_secrets),
    ("mixing sources", mix_sources),
]

#: Language models and seeded hashes have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
            if last is not None:
                discard(last)
            last = docs
    return docs
