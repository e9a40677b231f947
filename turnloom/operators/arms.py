"""Arms: ways to produce a dialogue for each note, and their scores.

A generator turns (note_id, clinical_note, conversation) rows into (note_id, generated)
rows; a language model is one that runs in mapInArrow with a model held by the worker.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from turnloom.functions import dialogue, numbers
from turnloom.operators import dataset, order, retrieval, stats
from turnloom.operators.embedscore import TextEncoder, bertscore
from turnloom.operators.rouge import rouge
from turnloom.sources import io

Generator = Callable[[DataFrame], DataFrame]

METRICS = ["rouge1", "rouge2", "rougeL", "numeric_grounding_recall", "numeric_precision", "fabricated_number_rate"]
#: A further metric, where an encoder is given.
EMBEDDED = "bertscore_f1"
COMPARED = ["rouge1", "rouge2", "rougeL", "numeric_grounding_recall", "fabricated_number_rate"]


def echo(pairs: DataFrame) -> DataFrame:
    """The reference dialogue itself: an upper bound."""
    return pairs.select("note_id", F.col("conversation").alias("generated"))


def first_half(pairs: DataFrame) -> DataFrame:
    """The first half of the turns, rounded up."""
    t = dialogue.turns(F.col("conversation"))
    return pairs.select("note_id", F.array_join(F.slice(t, F.lit(1), F.ceil(F.size(t) / 2).cast("int")), "\n").alias("generated"))


def successor(pairs: DataFrame, seed: int = dataset.SEED) -> DataFrame:
    """The dialogue of the next note in hash order: never its own, a lower bound."""
    moved = order.successors(pairs.select("note_id", "conversation"), "note_id", ["conversation"], seed)
    return moved.select("note_id", F.col("next_conversation").alias("generated"))


def retrieved(pairs: DataFrame) -> DataFrame:
    """The dialogue of the training note that is nearest by TF-IDF."""
    ids = io.written(dataset.split(pairs.select("note_id")).where("split = 'train'").select("note_id"), "train")
    notes = pairs.select("note_id", F.col("clinical_note").alias("text"))
    top = retrieval.Retriever().fit(notes.join(ids, "note_id", "left_semi")).top(notes, train_ids=ids)
    told = pairs.select("note_id", F.col("conversation").alias("generated"))
    return top.select(F.col("query_id").alias("note_id"), F.col("note_id").alias("__from"), "similarity").join(told.withColumnRenamed("note_id", "__from"), "__from").select("note_id", "generated", F.col("__from").alias("retrieved_note_id"), F.col("similarity").alias("retrieval_similarity"))


def mapped(generate: Callable) -> Generator:
    """A generator from a function over Arrow batches (note_id, clinical_note) -> (note_id, generated, gen_tokens)."""
    return lambda pairs: pairs.select("note_id", "clinical_note").mapInArrow(generate, "note_id string, generated string, gen_tokens long")


ARMS: dict[str, Generator] = {"half": first_half, "retrieval": retrieved, "self": echo, "successor": successor}


def scored(generated: DataFrame, stemmed: bool = True, encode: TextEncoder | None = None) -> DataFrame:
    """Metrics and flags of each row of generated(note_id, clinical_note, conversation, generated)."""
    return _scored(generated.withColumn("__n", numbers.numbers(F.col("clinical_note"))), stemmed, encode)


def _scored(generated: DataFrame, stemmed: bool, encode: TextEncoder | None, *also: str) -> DataFrame:
    """Those of generated(note_id, conversation, generated, __n: the note's numbers), and its columns `also` first."""
    g = F.col("generated")
    rows = generated.withColumn("__r", rouge(F.col("conversation"), g, stemmed)).withColumn("__g", numbers.numbers(g))
    cols: dict[str, Column] = {m: F.col(f"__r.{m}_f") for m in ("rouge1", "rouge2", "rougeL")}
    if encode:
        cols[EMBEDDED] = bertscore(F.col("conversation"), g, encode)["f1"]
    cols |= numbers.faithfulness(F.col("__n"), F.col("__g")) | dialogue.turn_format(g)
    return rows.select(*also, "note_id", *[v.alias(k) for k, v in cols.items()])


def run(pairs: DataFrame, arms: dict[str, Generator] | None = None, stemmed: bool = True, encode: TextEncoder | None = None) -> DataFrame:
    """arm and scores of every note under every arm.

    All arms meet their notes in one join, to which a note goes once and by its numbers only; its arms are scored in one task."""
    out = None
    for name, generator in (arms or ARMS).items():
        one = generator(pairs).select(F.lit(name).alias("arm"), "note_id", "generated")
        out = one if out is None else out.unionByName(one)
    told = pairs.select("note_id", "conversation", numbers.numbers(F.col("clinical_note")).alias("__n"))
    return _scored(told.join(out, "note_id"), stemmed, encode, "arm")


def wide(scores: DataFrame, metrics: list[str], arms: list[str]) -> DataFrame:
    """A row for each note, a column arm|metric for each score."""
    cells = [F.max(F.when(F.col("arm") == a, F.col(m))).alias(f"{a}|{m}") for a in arms for m in metrics]
    return scores.groupBy("note_id").agg(*cells)


def aggregate(scores: DataFrame, arms: list[str], metrics: list[str] = METRICS, **options) -> DataFrame:
    """arm, metric, mean and interval of each metric; all arms go through one set of draws."""
    out = stats.bootstrap(wide(scores, metrics, arms), "note_id", [f"{a}|{m}" for a in arms for m in metrics], **options)
    name = F.split("metric", "\\|")
    return out.select(F.get(name, F.lit(0)).alias("arm"), F.get(name, F.lit(1)).alias("metric"), *[c for c in out.columns if c != "metric"])


def valid_rate(scores: DataFrame) -> DataFrame:
    valid = F.col("starts_with_turn_marker") & F.col("has_doctor_turn") & F.col("has_patient_turn")
    return scores.groupBy("arm").agg(F.round(F.avg(valid.cast("int")), 6).alias("turn_format_valid_rate"))


class Speed:
    """Records and tokens of a table, counted while the job that needs it runs, and the time between start and result."""

    def __init__(self, made: DataFrame, tokens: str | None = None):
        self.observed = Observation()
        self.tokens = tokens
        self.made = made.observe(self.observed, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(tokens) if tokens else F.lit(None), F.lit(0)).cast("long").alias("tokens"))
        self.began = time.perf_counter()

    def result(self) -> dict[str, float | None]:
        """To be asked once the job has ended.  tokens_per_second is None without a token column, and so is memory of an
        accelerator that is not there."""
        s = time.perf_counter() - self.began
        found = self.observed.get
        return {"records_per_second": found["records"] / s, "tokens_per_second": found["tokens"] / s if self.tokens and found["tokens"] else None, "wall_clock_s": s, "peak_vram_gb": None, "n_records": found["records"]}


def throughput(made: DataFrame, tokens: str | None = None) -> dict[str, float | None]:
    """Speed of a run of `made` that does nothing else."""
    speed = Speed(made, tokens)
    speed.made.write.format("noop").mode("overwrite").save()
    return speed.result()
