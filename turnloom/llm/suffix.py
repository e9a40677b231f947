"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts earlier, in order of
document and position.

The string of SPAN bytes at a position is filed under its anchor: of its KEY-byte strings
the one with the least hash (the leftmost of equals).  Equal strings have equal anchors, so
only suffixes filed under one anchor need comparing, and consecutive positions mostly
share an anchor: a row of the first pass is a run of some thirty positions.

1. Each batch of documents finds its runs.  Runs whose whole surroundings repeat inside
   the batch are settled there (the later ones go); one of each is passed on, so a
   passage that a third of all documents share leaves a batch once.
2. Runs meet by anchor hash, a shuffle of fixed-length rows.  Of runs with equal
   surroundings the later ones go.  A first one is done with if all runs of its anchor
   have its surroundings, as most inside long copies and outside any do.
3. What is left lies at the edges of copies.  Its surroundings are cut from the texts
   and dealt to shards by anchor, in document order.  A shard reads them in batches.
   Each batch gets a suffix array (its positions in the order of their bytes), is
   merge-scanned against the levels there are, and what is new in it becomes a level;
   levels of equal size are merged, so a shard holds logarithmically many, each twice
   the next.  Suffixes are compared byte by byte, as far as SPAN bytes go.
4. Removed stretches meet their documents.

An anchor with many different surroundings (the edge of a passage that many documents
share) would be one long partition in steps 2 and 3.  Such anchors are looked for in a
sample, whose bound is HOT_SAMPLE; which are found does not change the result.  Their runs
are cut up into single positions, each filed under a hash of its own SPAN bytes.

Steps 1 and 2 settle equal surroundings by two hashes, 104 bits together.  The texts that
steps 3 and 4 need are picked with a bounded bit map of document ids before the shuffle
and by exact joins after it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import buffers, discard, materialise, maybe_in, mix64, signed, trimmed

SPAN = 100
KEY = 40
STARTS = SPAN - KEY + 1
#: Positions handled at once.
PIECE = 1 << 17
#: Runs of a shard (about): thirty positions each.
SHARD_RUNS = 10_000
#: Positions of a batch of a shard (about).
BATCH = 1 << 15
#: Documents in which crowded anchors are looked for, and how many different surroundings make one.
HOT_SAMPLE, HOT = 4000, 12
_B, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _rolled(x: np.ndarray, n: int, held: dict[int, np.ndarray], base: int = _B) -> np.ndarray:
    """Polynomial hash of the n bytes from each position, by doubling; held keeps powers of two."""
    if n == 1:
        return x.astype(np.uint64) + np.uint64(1)
    low = 1 << ((n - 1).bit_length() - 1)
    for size in [1 << i for i in range((n - 1).bit_length())]:
        if size not in held:
            half = held[size // 2] if size > 1 else None
            held[size] = _rolled(x, 1, held) if size == 1 else half[: len(half) - size // 2] * np.uint64(pow(base, size // 2, 1 << 64)) + half[size // 2 :]
    a, rest = held[low], n - low
    b = held[rest] if rest in held else _rolled(x, rest, held, base)
    m = len(x) - n + 1
    return a[:m] * np.uint64(pow(base, rest, 1 << 64)) + b[low : low + m]


def runs(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first position in it, positions, anchor hash, hash of the whole surroundings) of the runs of each piece.
    Runs of the anchors in hot (sorted) come as single positions under a hash of their bytes."""
    for s in range(0, max(0, len(data) - SPAN + 1), PIECE):
        e = min(len(data) - SPAN + 1, s + PIECE)
        x = data[s : e + SPAN - 1]
        held: dict[int, np.ndarray] = {}
        prints = mix64(_rolled(x, SPAN, held))
        keys = mix64(_rolled(x, KEY, held))
        where = np.arange(len(keys), dtype=np.uint64)
        low = (keys & ~np.uint64((1 << 20) - 1)) | where
        have = 1
        while have < STARTS:
            step = min(have, STARTS - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(s, e), "right") - 1
        inside = np.arange(s, e) + SPAN <= offsets[text + 1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.append(np.flatnonzero(new | ~inside), len(at))
        last = stop[np.searchsorted(stop, first, "right")] - 1
        anchor = at[first]
        key = keys[anchor]
        shape = ((anchor - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
        whole = mix64(prints[first] * np.uint64(3) + mix64(prints[last] ^ shape) + key)
        if hot is not None and len(hot) and (crowded := hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key).any():
            n = (last - first + 1)[crowded]
            at = np.repeat(first[crowded], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield text[at], at + s - offsets[text[at]], np.ones(len(at), np.int64), mix64(prints[at] ^ np.uint64(SPAN)), mix64(_rolled(x, SPAN, {}, _B2)[at])
            first, last, key, whole = (c[~crowded] for c in (first, last, key, whole))
        yield text[first], first + s - offsets[text[first]], last - first + 1, key, whole


#: place: first position * 256 + positions * 2 + (1 if settled); few wide fields keep shuffled rows short.
_RUN = "key long, whole long, doc long, tie int, place long"
#: Bits of the anchor hash that runs are dealt by: anchors that share them are compared in vain, no more.
KEY_BITS = 40


def _first_pass(hot):
    """Runs to compare (kind 0) and runs that are settled (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b["text"])
            found = list(runs(data, offsets, hot.value))
            if not found:
                continue
            text, p, n, key, whole = (np.concatenate(x) for x in zip(*found))
            doc = b["doc"].to_numpy(zero_copy_only=False)[text]
            tie = b["tie"].to_numpy(zero_copy_only=False)[text]
            order = np.lexsort((p, tie, doc, whole))
            doc, tie, p, n, key, whole = (x[order] for x in (doc, tie, p, n, key, whole))
            same = np.zeros(len(p), bool)
            same[1:] = (whole[1:] == whole[:-1]) & (key[1:] == key[:-1])
            again = np.zeros(len(p), bool)  # a repeated row of the table, no other occurrence
            again[1:] = same[1:] & (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (p[1:] == p[:-1])
            keep = ~again
            # Settled runs need no partner: they are spread by place.
            key = np.where(same, mix64(key + p.astype(np.uint64) + doc.astype(np.uint64)), key) >> np.uint64(64 - KEY_BITS)
            place = (p << 8) | (n << 1) | same
            cols = (signed(key), signed(whole), doc, tie, place)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], [x.split()[0] for x in _RUN.split(", ")])

    return run


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (key, whole) of each batch."""
    for b in batches:
        found = list(runs(*buffers(b["text"])))
        both = np.unique(np.concatenate([np.stack([key, whole]) for *_, key, whole in found], axis=1), axis=1) if found else np.zeros((2, 0), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(both[0].copy())), pa.array(signed(both[1].copy()))], ["key", "whole"])


def crowded(texts: DataFrame) -> np.ndarray:
    """Sorted anchor hashes that have HOT surroundings or more in a sample of about HOT_SAMPLE texts."""
    n = texts.count()
    part = texts.where(F.pmod(F.xxhash64("doc", "tie", F.lit("crowded")), F.lit(1_000_000)) < 1_000_000 * min(1.0, HOT_SAMPLE / max(1, n)))
    rows = part.where(F.octet_length("text").between(SPAN, PIECE)).mapInArrow(trimmed(_surroundings), "key long, whole long").distinct()
    keys = rows.groupBy("key").count().where(F.col("count") >= HOT).select("key").toArrow()["key"].to_numpy()  # of a bounded sample
    return np.sort(keys.astype(np.int64).view(np.uint64))


class Level(NamedTuple):
    """A suffix array: the starts `at` in data of different strings of SPAN bytes, in the order of their bytes."""

    data: np.ndarray
    at: np.ndarray

    def strings(self) -> np.ndarray:
        return strings(self.data, self.at)


def strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SPAN bytes from each place, as byte strings, which numpy orders as unsigned bytes."""
    if len(data) < SPAN:
        return np.zeros(0, f"S{SPAN}")
    return np.ndarray((len(data) - SPAN + 1,), f"S{SPAN}", np.ascontiguousarray(data), strides=(1,))[at]


class LogIndex:
    """Suffix arrays, the sizes of which fall by half at least."""

    def __init__(self):
        self.levels: list[Level] = []

    def scan(self, ranked: np.ndarray) -> np.ndarray:
        """Merge-scan of sorted strings against every level: which of them are in one, to the last byte."""
        found = np.zeros(len(ranked), bool)
        for level in self.levels:
            held = level.strings()
            at = np.minimum(np.searchsorted(held, ranked), len(held) - 1)
            found |= held[at] == ranked
        return found

    def add(self, new: Level) -> None:
        if not len(new.at):
            return
        while self.levels and len(self.levels[-1].at) < 2 * len(new.at):
            old = self.levels.pop()
            place = np.searchsorted(old.strings(), new.strings())
            new = Level(np.concatenate([old.data, new.data]), np.insert(old.at, place, new.at + len(old.data)))
        self.levels.append(new)

    def insert(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Take the suffixes at these places in order; which of them agree in SPAN bytes with one before."""
        s = strings(data, at)
        array = np.argsort(s, kind="stable")
        ranked = s[array]
        first = np.ones(len(ranked), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        known = self.scan(ranked)
        self.add(Level(data, at[array][first & ~known]))
        out = np.empty(len(at), bool)
        out[array] = known | ~first
        return out


_CUT = "doc long, tie int, p int, key long, around binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of the runs of each document."""
    for b in batches:
        for row in range(len(b)):
            text = b["text"][row].as_py()
            r = b["runs"][row].values.flatten()
            p, n, key = (x.to_numpy() for x in r)
            around = [text[i : i + m + SPAN - 1] for i, m in zip(p.tolist(), n.tolist())]
            k = len(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, b["doc"][row].as_py())), pa.array(np.full(k, b["tie"][row].as_py(), np.int32)), pa.array(p), pa.array(key), pa.array(around, pa.binary())],
                [x.split()[0] for x in _CUT.split(", ")],
            )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches (doc, tie, s, e) that go, of a shard's runs in document order."""
    index = LogIndex()
    before = None
    for b in batches:
        step = BATCH // STARTS
        for at in range(0, len(b), step):
            part = b.slice(at, step)
            doc, tie, p = (part[c].to_numpy(zero_copy_only=False) for c in ("doc", "tie", "p"))
            again = np.zeros(len(p), bool)
            again[1:] = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (p[1:] == p[:-1])
            again[0] = before == (doc[0], tie[0], p[0])
            before = (doc[-1], tie[-1], p[-1])
            data, offsets = buffers(part["around"])
            n = np.maximum(offsets[1:] - offsets[:-1] - SPAN + 1, 0)
            n[again] = 0
            row = np.repeat(np.arange(len(p)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            gone = index.insert(data, offsets[row] + nth)
            # Maximal stretches of neighbouring positions that go.
            start = gone.copy()
            start[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
            end = gone.copy()
            end[:-1] &= ~(gone[1:] & (row[1:] == row[:-1]))
            i, j = np.flatnonzero(start), np.flatnonzero(end)
            s, e = p[row[i]] + nth[i], p[row[i]] + nth[j] + SPAN
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[i]]), pa.array(tie[row[i]]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc", "tie", "s", "e"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in range(len(b)):
            text = memoryview(b["text"][row].as_buffer())
            s, e = (x.to_numpy() for x in b["spans"][row].values.flatten())
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] > e[:-1]
            s, e = s[new], np.append(e[np.flatnonzero(new)[1:] - 1], e[-1])
            left = hashlib.sha256()
            at = 0
            for i, j in zip(s.tolist(), e.tolist()):
                left.update(text[at:i])
                at = j
            left.update(text[at:])
            out.append((int((e - s).sum()), len(s), left.hexdigest()))
        gone, spans, sha = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b["doc"], b["tie"], pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc", "tie", "gone", "spans", "sha"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs(doc_id, text, ...); other columns are not read.

    A null text is empty.  An empty table gives an empty result.  A null doc_id comes after all others.  Rows that repeat both
    doc_id and text are one document and are answered alike; rows that share a doc_id with
    different texts count as different documents that start at the same place in the order.
    """
    spark = docs.sparkSession
    none = F.lit((1 << 63) - 1)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc"), F.hash("text").alias("tie"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    hot = spark.sparkContext.broadcast(crowded(texts))
    first = texts.where(F.octet_length("text") >= SPAN).mapInArrow(trimmed(_first_pass(hot)), _RUN)
    # Of runs with equal surroundings the first stays; it needs a closer look if its anchor has others.
    by_key = Window.partitionBy("key").orderBy("whole", "doc", "tie", "place")
    first = first.withColumn("prev", F.lag(F.struct("whole", "doc", "tie", "place")).over(by_key))
    first = first.withColumn("copy", F.coalesce(F.expr("prev.whole = whole"), F.lit(False)))
    first = first.withColumn("forms", F.sum(F.when(F.col("copy"), 0).otherwise(1)).over(Window.partitionBy("key")))
    kind = F.expr("case when place & 1 = 1 then 1 when copy and prev.doc = doc and prev.tie = tie and prev.place = place then null when copy then 1 when forms > 1 then 0 end")
    place = F.col("place")
    p, n = F.shiftright(place, 8).cast("int").alias("p"), (F.shiftright(place, 1).bitwiseAND(127)).cast("int").alias("n")
    runs_ = materialise(first.select(kind.alias("kind"), "doc", "tie", p, n, "key").where("kind is not null"), "runs")
    settled = runs_.where("kind = 1").select("doc", "tie", F.col("p").alias("s"), (F.col("p") + F.col("n") + (SPAN - 1)).alias("e"))
    open_ = runs_.where("kind = 0")
    n = open_.count()
    lists = open_.groupBy("doc", "tie").agg(F.collect_list(F.struct("p", "n", "key")).alias("runs"))
    around = maybe_in(texts, "doc", open_.select("doc")).join(lists, ["doc", "tie"]).mapInArrow(trimmed(_cut), _CUT)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / SHARD_RUNS))
    around = around.repartition(shards, "key").sortWithinPartitions("doc", "p", "tie")
    stretches = materialise(around.mapInArrow(trimmed(_indexed), "doc long, tie int, s int, e int").union(settled), "stretches")
    discard(runs_)
    spans = stretches.groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    left = maybe_in(texts, "doc", stretches.select("doc")).join(spans, ["doc", "tie"]).mapInArrow(trimmed(_kept), "doc long, tie int, gone long, spans long, sha string")
    left = left.dropDuplicates(["doc", "tie"])
    base = texts.select("doc", "tie", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = base.join(left, ["doc", "tie"], "left")
    return out.select(
        F.when(F.col("doc") < none, F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )
