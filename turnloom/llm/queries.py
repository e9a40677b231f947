"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import align, ann, chat, decontam, langid, licences, lmscore, minhash, mixing, secrets, spelling, sql, suffix, toxicity
from turnloom.llm.common import crc_bucket, small_batches, table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (crc_bucket(5) == 0).alias("held_out"), "text")
    return langid.predictions(rows, langid.fit(docs, crc_bucket(5) != 0), "held_out")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (crc_bucket(4) == 2).alias("held_out"), "text")
    return toxicity.score(rows, toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_bucket(4) != 2), "held_out")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.pieces(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.tokens(table(spark, sf_dir, "documents"))


def _tuned(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k: _tuned(f)
    for k, f in {
        "op1_minhash": op1,
        "op2_mixing": op2,
        "op3_suffix": op3,
        "op4_secrets": op4,
        "op5_langid": op5,
        "op6_lmscore": op6,
        "op7_toxicity": op7,
        "op8_ann": op8,
        "op9_licences": op9,
        "op10_decontam": op10,
        "op11_chat": op11,
        "op12_spelling": op12,
        "op13_alignment": op13,
    }.items()
}

ORACLE: dict[str, str] = {
    "op1_minhash": sql.NEAR_DUPLICATES,
    "op3_suffix": sql.REPEATS,
    "op10_decontam": sql.DECONTAMINATION,
    "op2_mixing": mixing.ORACLE_SQL,
    "op9_licences": licences.ORACLE_SQL,
    "op11_chat": chat.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
}
