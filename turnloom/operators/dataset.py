"""From raw pairs to an exact-deduplicated, split dataset."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import dialogue, text
from turnloom.operators import continuation, order
from turnloom.sources import io

FRACTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}
SEED = 42


def keepers(notes: DataFrame, note: str, ordinal: str) -> DataFrame:
    """For each distinct note its id and the least ordinal: a partial aggregate, one row for each text."""
    return notes.groupBy(text.note_id(F.col(note)).alias("note_id")).agg(F.min(ordinal).alias("kept"))


def deduplicated(notes: DataFrame, note: str, ordinal: str) -> DataFrame:
    """The first row of each distinct note, with its note_id; texts are not shuffled when the ids fit a broadcast."""
    rows = notes.withColumn("note_id", text.note_id(F.col(note)))
    first = keepers(notes, note, ordinal).select(F.col("note_id").alias("__id"), "kept")
    return rows.join(first, (rows.note_id == first["__id"]) & (rows[ordinal] == first.kept), "left_semi")


def dropped(notes: DataFrame, note: str, ordinal: str) -> DataFrame:
    """The other rows: ordinal, note_id and the ordinal that was kept."""
    rows = notes.select(ordinal, text.note_id(F.col(note)).alias("note_id"))
    first = keepers(notes, note, ordinal)
    return rows.join(first, "note_id").where(F.col(ordinal) > F.col("kept")).select(ordinal, "note_id", "kept")


def records(pairs: DataFrame, ordinal: str, note: str = "data", conversation: str = "conversation") -> DataFrame:
    """The processed dataset of raw pairs.  Copies go before dialogues are looked at, so a malformed copy raises nothing."""
    rows = deduplicated(pairs, note, ordinal)
    body = dialogue.without_preamble(F.col(conversation))
    rows = rows.withColumn("__body", body)
    b = F.col("__body")
    return rows.select(
        "note_id",
        F.col(note).alias("clinical_note"),
        F.length(note).alias("note_len_chars"),
        b.alias("conversation"),
        F.length(b).alias("conversation_len_chars"),
        dialogue.n_turns(b).alias("num_turns"),
        dialogue.speaker_turns(b, "Doctor").alias("num_doctor_turns"),
        dialogue.speaker_turns(b, "Patient").alias("num_patient_turns"),
        (F.length(conversation) > F.length(b)).alias("preamble_stripped"),
    )


def split(ids: DataFrame, key: str = "note_id", fractions: dict[str, float] = FRACTIONS, seed: int = SEED) -> DataFrame:
    """ids with a column `split`, by rank in hash order; sizes are rounded half to even, the last split gets the rest."""
    rows, total = order.ranked(ids, key, seed, "__rank")
    names = list(fractions)
    upto = F.lit(0)
    out = None
    for name in names[:-1]:
        upto = upto + F.bround(F.col("n") * F.lit(fractions[name])).cast("long")
        test = F.col("__rank") <= upto
        out = F.when(test, name) if out is None else out.when(test, name)
    out = F.lit(names[-1]) if out is None else out.otherwise(names[-1])
    return rows.crossJoin(F.broadcast(total)).withColumn("split", out).drop("__rank", "n")


def split_texts(notes: DataFrame, note: str, ordinal: str, seed: int = SEED) -> dict[str, DataFrame]:
    """note_id, text of each split of the deduplicated notes.  Texts are not shuffled, whatever their number: a row's split follows
    from its own hash and the first and last of the split, and a bit map (of one size at most) knows all copies, so that only
    rows that it takes for copies are looked up."""
    rows = notes.select(F.col(ordinal).alias("__at"), text.note_id(F.col(note)).alias("note_id"), F.col(note).alias("text"))
    key = lambda: F.struct(order.hashed(seed, F.col("note_id")).alias("h"), F.col("note_id").alias("id"))
    ids = split(keepers(notes, note, ordinal).where("note_id is not null").select("note_id"), seed=seed)
    ends = ids.groupBy("split").agg(F.min(key()).alias("first"), F.max(key()).alias("last")).collect()  # a row for each split
    copies = io.written(dropped(notes, note, ordinal).select(F.col(ordinal).alias("__at"), "note_id"), "copies")
    hashed = lambda: F.pmod(F.xxhash64("__at", "note_id"), F.lit(1 << continuation.BITS))
    bits = notes.sparkSession.sparkContext.broadcast(continuation._bit_map(copies.select(hashed().alias("h"))))

    @F.pandas_udf("boolean")
    def copied(h: pd.Series) -> pd.Series:
        at = h.to_numpy()
        return pd.Series(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    out = {}
    for name in FRACTIONS:
        known = F.lit(False)
        for r in ends:
            if r["split"] == name:
                low, high = (F.struct(F.lit(x.h).alias("h"), F.lit(x.id).alias("id")) for x in (r["first"], r["last"]))
                known = F.col("note_id").isNotNull() & (key() >= low) & (key() <= high)
        own = rows.where(known)
        told = own.withColumn("__copied", copied(hashed()))
        asked = told.where("__copied").drop("__copied").join(copies, ["__at", "note_id"], "left_anti")
        out[name] = told.where("not __copied").drop("__copied").unionByName(asked).select("note_id", "text")
    return out


def split_like_mt19937(ids: list[str], fractions: dict[str, float] = FRACTIONS, seed: int = SEED) -> dict[str, list[str]]:
    """The split by a seeded shuffle of the sorted ids on the driver, for corpora whose ids fit there."""
    ids = sorted(ids)
    random.Random(seed).shuffle(ids)
    out, at, names = {}, 0, list(fractions)
    for name in names:
        n = len(ids) - at if name == names[-1] else round(len(ids) * fractions[name])
        out[name] = sorted(ids[at : at + n])
        at += n
    return out


def overlap(splits: DataFrame, key: str = "note_id") -> DataFrame:
    """One row: ids in several splits, ids, rows."""
    each = splits.groupBy(key).agg(F.count_distinct("split").alias("k"), F.count("*").alias("rows"))
    return each.agg(F.count_if(F.col("k") > 1).alias("n_overlap"), F.count("*").alias("n_ids"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean (to one decimal), min, max of numeric columns, in one pass."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.min(c).cast("long").alias(f"{c}_min"), F.max(c).cast("long").alias(f"{c}_max"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(f"{c}_mean", 1).alias("mean"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max")) for c in columns])
    return one.select(F.inline(rows))


def split_counts(splits: DataFrame) -> DataFrame:
    """split, n, pct (to one decimal)."""
    sizes = splits.groupBy("split").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    return sizes.crossJoin(F.broadcast(total)).select("split", "n", F.round(F.col("n") * 100.0 / F.col("all"), 1).alias("pct"))
