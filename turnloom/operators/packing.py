"""Token counts of texts and packing them into training sequences of one size.

Packing fills bins by best fit, longest first, but over lengths instead of texts: a histogram of lengths (as many rows
as a bin holds tokens) is all the driver sees, and bins that are filled alike are one range of numbers.  Each text
then finds its place by its length and its rank among the texts of that length in hash order; ranks are found in
groups of about GROUP texts, so a length that a third of all texts have is no task of its own.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import bpe
from turnloom.functions.text import TEMPLATE
from turnloom.operators.order import hashed
from turnloom.sources import io

#: Tokens of a training sequence.
CAPACITY = 4096
SEED = 42
#: Texts of one length that are ranked together.
GROUP = 100_000


class Tokenizer:
    """Token ids and counts as columns.  The driver reads the vocabulary file, whose bytes go to the executors."""

    def __init__(self, spark: SparkSession, path: str, special: dict[str, int] | None = None):
        with open(path, "rb") as f:
            data = f.read()
        self.size = len(bpe.loaded(data).ranks)
        self.special = tuple((special or {}).items())
        self.data = spark.sparkContext.broadcast(data)

    @classmethod
    def of_chat(cls, spark: SparkSession, path: str) -> Tokenizer:
        """The marks of the chat template are one token each, numbered after the vocabulary."""
        start, end = TEMPLATE[0].split("{role}")[0], TEMPLATE[2].strip("\n")
        plain = cls(spark, path)
        plain.special = ((start, plain.size + 1), (end, plain.size + 2))
        return plain

    def ids(self, text: Column) -> Column:
        """array<int>; empty for null."""
        data, special = self.data, self.special

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            merges = bpe.loaded(data.value, special)
            return texts.map(merges.encode)

        return encode(text)

    def count(self, text: Column) -> Column:
        """Tokens of a text as long; 0 for null."""
        data, special = self.data, self.special

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            merges = bpe.loaded(data.value, special)
            return texts.map(lambda t: len(merges.encode(t))).astype("int64")

        return count(text)


@dataclass(frozen=True)
class Slots:
    """Where texts go: those of length `length` whose rank in it is from `start` on, and below that of the next row, stand
    in bins from `first` on, `each` to a bin, the first of them at `offset`."""

    length: np.ndarray
    start: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Slots:
    """Best fit, longest first, of counts[length] texts of each length from 1 to capacity.  A range of bins with as much
    room is filled as one; of ranges with equal room the one of smaller numbers comes first."""
    if odd := [n for n in counts if not 0 < n <= capacity]:
        raise ValueError(f"lengths {sorted(odd)[:5]} are not from 1 to {capacity}")
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    rows, bins = [], 0

    def put(left: int, first: int, number: int) -> None:
        if number and left:
            if left not in room:
                bisect.insort(rooms, left)
            bisect.insort(room.setdefault(left, []), (first, number))

    for length in sorted(counts, reverse=True):
        placed, wanted = 0, counts[length]
        while placed < wanted:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, number = room[left].pop(0)
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first = capacity, bins
                number = -(-(wanted - placed) // (capacity // length))
                bins += number
            each = left // length
            full = min(number, (wanted - placed) // each)
            if full:
                rows.append((length, placed, first, each, capacity - left))
                placed += full * each
                put(left - each * length, first, full)
            if full < number and placed < wanted:
                some = wanted - placed
                rows.append((length, placed, first + full, some, capacity - left))
                placed = wanted
                put(left - some * length, first + full, 1)
                full += 1
            put(left, first + full, number - full)
    return Slots(*(np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5)), bins)


def segments(texts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """texts(note_id, n_tokens) with `part` and the part's own n_tokens: a text longer than a bin is cut into whole bins and a
    rest, one without tokens is one part of none.  Other columns go along."""
    whole = F.col("n_tokens").cast("long")
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(whole / capacity).cast("long") - 1, F.lit(0)))
    out = texts.withColumn("n_tokens", F.coalesce(whole, F.lit(0))).withColumn("part", F.explode(F.coalesce(parts, F.array(F.lit(0).cast("long")))))
    return out.withColumn("n_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("long"))


def pack(texts: DataFrame, capacity: int = CAPACITY, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """note_id, part, bin_id, offset, n_tokens of texts(note_id, n_tokens): every part in a bin, none over capacity, none overlapping
    another; a part without tokens has no bin.  note_id should be unique; rows that share it are still placed apart, but
    which of them gets which place is open."""
    path = io.scratch(texts.sparkSession, "lengths")
    texts.select("note_id", "n_tokens").write.parquet(path)  # texts are tokenized once
    cut = segments(texts.sparkSession.read.parquet(path), capacity)
    rows = cut.where("n_tokens > 0")
    counts = {r.n_tokens: r.c for r in rows.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}  # `capacity` rows at most
    slots = plan(counts, capacity)
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(slots)
    sizes = spark.createDataFrame([(n, max(1, -(-c // group))) for n, c in counts.items()], "n_tokens long, __groups long")
    key = F.concat_ws("|", F.col("note_id").cast("string"), F.col("part").cast("string"))
    dealt = rows.join(F.broadcast(sizes), "n_tokens").withColumn("__h", hashed(seed, key))
    dealt = dealt.withColumn("__g", F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") % F.col("__groups"))
    before = dealt.groupBy("n_tokens", "__g").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy("n_tokens").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("n_tokens", "__g", F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("n_tokens", "__g").orderBy("__h", "note_id", "part")
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1).join(before, ["n_tokens", "__g"])

    @F.pandas_udf("bin_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = held.value
        # Rows of a plan go from long to short, and by start within a length.
        order = np.lexsort((s.start, s.length))
        size, start = s.length[order], s.start[order]
        step = int(max(start.max(), rank.max())) + 1
        at = order[np.searchsorted(size * step + start, length.to_numpy() * step + rank.to_numpy(), "right") - 1]
        inner = rank.to_numpy() - s.start[at]
        return pd.DataFrame({"bin_id": s.first[at] + inner // s.each[at], "offset": s.offset[at] + inner % s.each[at] * length.to_numpy()})

    out = ranked.withColumn("__p", place(F.col("n_tokens"), F.col("__before") + F.col("__r"))).select("note_id", "part", "__p.bin_id", "__p.offset", "n_tokens")
    return out.union(cut.where("n_tokens = 0").select("note_id", "part", F.lit(None).cast("long"), F.lit(None).cast("long"), "n_tokens"))


def sequences(placed: DataFrame, ids: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """bin_id, n_tokens, starts (of the parts in it) and token ids of each bin, from pack() and ids(note_id, ids): a bin's
    parts, one after another, `capacity` tokens at most."""
    cut = segments(ids.withColumn("n_tokens", F.size("ids")), capacity)
    own = cut.select("note_id", "part", F.slice("ids", (F.col("part") * capacity + 1).cast("int"), F.col("n_tokens").cast("int")).alias("ids"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    bins = placed.where("bin_id is not null").join(own, ["note_id", "part"]).groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), parts.alias("p"))
    return bins.select("bin_id", "n_tokens", F.col("p.offset").alias("starts"), F.flatten("p.ids").alias("ids"))


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_bins, n_parts, n_tokens and the share of the bins' room that holds tokens; one row."""
    bins, tokens = F.count_distinct("bin_id"), F.coalesce(F.sum("n_tokens"), F.lit(0))
    return placed.agg(bins.alias("n_bins"), F.count("*").alias("n_parts"), tokens.alias("n_tokens"), F.round(F.try_divide(tokens, bins * capacity), 6).alias("fill"))
