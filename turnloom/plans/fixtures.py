"""How the driver's tables become notes, dialogues and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import dialogue
from turnloom.functions.text import note_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, raw: one line for each turn; system turns carry no marker and so become a preamble."""
    turns = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("Patient: "), "text")).when(F.col("role") == "assistant", F.concat(F.lit("Doctor: "), "text")).otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))  # a dialogue's turns
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("raw"))


def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues(spark, sf_dir).withColumn("conversation", dialogue.without_preamble(F.col("raw")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, note_id, text."""
    return table(spark, sf_dir, "documents").select("doc_id", note_id(F.col("text")).alias("note_id"), "text")


def distinct_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id and text of the first copy of each document."""
    from turnloom.operators.dataset import deduplicated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, "text", "doc_id").select("doc_id", "note_id", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id (the padded conv_id), clinical_note and conversation of each dialogue and the document of its number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("clinical_note"))
    return stripped(spark, sf_dir).join(docs, "conv_id").select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("note_id"), "clinical_note", "conversation")
