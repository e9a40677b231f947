"""Memorisation probe: does a model continue a dialogue more like the truth than like a control?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import dialogue
from turnloom.operators import continuation, order, stats
from turnloom.operators.rouge import rouge
from turnloom.sources import io

#: A difference from which a detected effect counts as substantial.
MATERIAL = 0.05
SEED, RECORDS = 42, 100


def cut(dialogues: DataFrame) -> DataFrame:
    """note_id, prefix, continuation; dialogues that are too short are left out."""
    return dialogues.select("note_id", dialogue.halves(F.col("conversation")).alias("h")).where("h is not null").select("note_id", "h.prefix", "h.continuation")


def probe(
    dialogues: DataFrame,
    generate: Callable[[Column], Column] | None = None,
    n: int | None = RECORDS,
    stemmed: bool = True,
    seed: int = SEED,
    continue_all: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """note_id, rougeL_vs_true and rougeL_vs_control of each record.

    The sample is drawn before short dialogues go.  The control is the continuation of the
    next record in hash order, chosen before anything is generated.  generate: continuation
    from the prefix column; by default the prefix itself.  continue_all: (note_id, generated) from
    rows of (note_id, prefix), for what needs a job of its own; see from_corpus().
    """
    halves = cut(order.first_n(dialogues, "note_id", n, seed))
    if continue_all:
        path = io.scratch(dialogues.sparkSession, "halves")
        halves.write.parquet(path)  # dialogues are made and cut once
        halves = dialogues.sparkSession.read.parquet(path)
        moved = order.successors(halves.select("note_id", "continuation"), "note_id", ["continuation"], seed)
        made = moved.join(continue_all(halves.select("note_id", "prefix")), "note_id")
    else:
        moved = order.successors(halves, "note_id", ["continuation"], seed)
        made = moved.withColumn("generated", (generate or (lambda x: x))(F.col("prefix")))
    score = lambda ref: rouge(F.col(ref), F.col("generated"), stemmed)["rougeL_f"]
    return made.select("note_id", score("continuation").alias("rougeL_vs_true"), score("next_continuation").alias("rougeL_vs_control"))


def from_corpus(corpus: DataFrame, new_words: int = continuation.NEW_WORDS) -> Callable[[DataFrame], DataFrame]:
    """continue_all by a model that has learned corpus(note_id, text) by heart and nothing besides."""

    def run(prefixes: DataFrame) -> DataFrame:
        texts = prefixes.select(F.col("note_id").alias("id"), F.col("prefix").alias("text"))
        return continuation.continued(texts, corpus, new_words).select(F.col("id").alias("note_id"), "generated")

    return run


def delta(scores: DataFrame, **options) -> DataFrame:
    """metric, estimate, ci_low, ci_high, n, excludes_zero of both scores and of their difference; one set of draws."""
    rows = scores.withColumn("delta", F.col("rougeL_vs_true") - F.col("rougeL_vs_control"))
    out = stats.bootstrap(rows, "note_id", ["rougeL_vs_true", "rougeL_vs_control", "delta"], point="estimate", **options)
    return out.withColumn("excludes_zero", stats.excludes_zero(F.col("ci_low"), F.col("ci_high")))


def verdict(deltas: DataFrame, material: float = MATERIAL) -> DataFrame:
    """delta, relative_lift (null if the control's mean is 0) and verdict, from delta()'s rows."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    one = deltas.agg(pick("delta", "estimate").alias("delta"), pick("delta", "excludes_zero").alias("sure"), pick("rougeL_vs_control", "estimate").alias("control"))
    says = F.when(~F.col("sure") | (F.col("delta") <= 0), "not detected").when(F.col("delta") < material, "detectable but small").otherwise("substantial")
    return one.select("delta", F.round(F.try_divide("delta", "control"), 6).alias("relative_lift"), says.alias("verdict"))


def report(deltas: DataFrame, verdicts: DataFrame) -> str:
    v = verdicts.first()
    rows = "".join(f"| {r.metric} | {r.estimate:.4f} | [{r.ci_low:.4f}, {r.ci_high:.4f}] |\n" for r in deltas.collect())
    lift = "n/a" if v.relative_lift is None else f"{100 * v.relative_lift:+.1f}%"
    return f"# Contamination probe\n\nVerdict: **{v.verdict}** (delta {v.delta:+.4f}, relative lift {lift})\n\n| Metric | Mean | 95% CI |\n|---|---|---|\n{rows}"
