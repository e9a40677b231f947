"""Readers and writers of the library's tables and reports."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_COLUMNS = ("data", "conversation")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw pairs; the header must name exactly RAW_COLUMNS, in any order.  Quoted line breaks and doubled quotes are read."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    found = spark.read.options(**options, inferSchema=False).csv(path)
    if sorted(found.columns) != sorted(RAW_COLUMNS):
        raise ValueError(f"columns are {found.columns}, not {list(RAW_COLUMNS)}")
    return found.select(*[F.col(c).cast("string") for c in RAW_COLUMNS])


def write_pairs_csv(df: DataFrame, path: str) -> None:
    df.select(*RAW_COLUMNS).write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True).csv(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a dataset that write_splits() wrote: other splits' files are not opened."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def note_at(split: DataFrame, which: int | str) -> DataFrame:
    """One note by its id, or by its place (from 0) in id order; none there raises."""
    if isinstance(which, str) and which.startswith("note-"):
        out = split.where(F.col("note_id") == which)
    else:
        out = split.orderBy("note_id").offset(int(which)).limit(1) if int(which) >= 0 else split.limit(0)
    if out.isEmpty():
        raise LookupError(f"no note {which!r}")
    return out


SCORES = ("rouge1", "rouge2", "rougeL", "bertscore_f1", "numeric_grounding_recall", "numeric_precision", "fabricated_number_rate")
FLAGS = {"starts_with_turn_marker": "boolean", "num_turns": "bigint", "has_doctor_turn": "boolean", "has_patient_turn": "boolean"}
_RECORD = ", ".join(["note_id: string", *(f"{s}: double" for s in SCORES), *(f"{k}: {v}" for k, v in FLAGS.items())])
ARM_SCHEMA = f"arm string, model_name string, decoding struct<do_sample: boolean>, records array<struct<{_RECORD}>>"


def read_arms(spark: SparkSession, pattern: str, names: list[str] | None = None) -> DataFrame:
    """arm, decoding and scores of the records of every results.json that pattern matches.

    An arm is named by its file or, where that says nothing, by its folder; of files with
    one name the last by path counts.  names: keep these arms; unknown ones are passed over,
    but no match at all raises.
    """
    files = spark.read.schema(ARM_SCHEMA).json(pattern, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    named = files.withColumn("arm", F.coalesce("arm", F.element_at(F.split("path", "/"), -2)))
    if names is not None:
        named = named.where(F.col("arm").isin(names))
    last = named.groupBy("arm").agg(F.max_by(F.struct("decoding", "records"), "path").alias("x"))
    if last.isEmpty():
        raise FileNotFoundError(f"no results in {pattern}")
    return last.select("arm", "x.decoding", F.inline("x.records"))


def arm_json(scores: DataFrame, header: dict[str, Column]) -> DataFrame:
    """One JSON text (`value`) for each arm; an arm's records are an evaluation sample, gathered in one row."""
    records = F.sort_array(F.collect_list(F.struct("note_id", *[c for c in scores.columns if c in SCORES or c in FLAGS])))
    one = scores.groupBy("arm").agg(records.alias("records"))
    return one.select("arm", F.to_json(F.struct("arm", *[v.alias(k) for k, v in header.items()], "records")).alias("value"))


def write_arms(scores: DataFrame, folder: str, header: dict[str, Column]) -> None:
    arm_json(scores, header).select(F.col("arm").alias("dir"), "value").write.mode("overwrite").partitionBy("dir").text(folder)


def as_records(df: DataFrame) -> list[dict]:
    """The rows of a report, which is small by nature, as dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def read_config(path: str) -> dict:
    """A mapping from a YAML file; without a YAML library the file must be JSON, which is YAML too."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def write_json(data: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, ensure_ascii=False)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of whole files; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.replace(F.try_validate_utf8(F.col("content").cast("string")), F.lit("\x00"), F.lit("")).alias("valid"), "content").select(
        "path", F.coalesce("valid", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))).alias("text")
    )


def read_audio(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content of recordings, for a transcriber in mapInArrow."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir (a temporary one only for a local session that names none); it goes when the driver's JVM ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = held.get() if held.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="turnloom-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared}/turnloom-{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back as it ends, not when the driver's memory is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(rows: DataFrame, tag: str) -> DataFrame:
    """rows as a Parquet table in a scratch folder: what made them runs once, and a scan has as many tasks as its files need."""
    path = scratch(rows.sparkSession, tag)
    with freed(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
