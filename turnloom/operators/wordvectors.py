"""Word vectors learned from a corpus: co-occurrence, positive pointwise mutual information, randomised SVD.

Words near each other are counted in the tasks that read the texts.  The weighted matrix stays a distributed table, a
row of it for each word; its products with thin matrices (words by DIMS + MORE numbers, bounded by VOCABULARY whatever the
corpus) are jobs over the rows, and only these thin matrices are factored on the driver (Halko, Martinsson and
Tropp, 2011).  Draws are seeded, and signs of the factors are set, so a run repeats.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.embedscore import DIMS as HASHED_DIMS
from turnloom.operators.embedscore import WordEncoder, hashed, tokenize
from turnloom.sources import io

#: Most frequent words that get vectors, words to either side that count as near, numbers of a vector.
VOCABULARY, WINDOW, DIMS = 20_000, 4, 64
#: Columns of the random sketch beyond DIMS, rounds of power iteration, pairs that a task counts before it hands them on.
MORE, ROUNDS, HELD = 10, 2, 1 << 20
#: Frequencies of context words count to this power, which makes rare ones less surprising.
SMOOTHING = 0.75
SEED = 42


def words(texts: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The most frequent words of texts(text), most frequent first, ties by code points; size entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                held.update(tokenize(t.as_py() or ""))
            if len(held) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    each = texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in each.orderBy(F.desc("n"), "word").limit(size).collect()]


def near(texts: DataFrame, vocabulary: list[str], window: int = WINDOW) -> DataFrame:
    """i, j, n: how often words i and j of the vocabulary stand within `window` words of each other in texts(text), both
    ways round, so (i, j) and (j, i) are alike; words outside the vocabulary keep their places."""
    held, size = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)}), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, n = held.value, [np.zeros(0, np.int64)], 0

        def pack() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found // size, pa.int32()), pa.array(found % size, pa.int32()), pa.array(times)], ["i", "j", "n"])

        for b in batches:
            for t in b["text"]:
                ids = np.array([place.get(w, -1) for w in tokenize(t.as_py() or "")], np.int64)
                for d in range(1, min(window, len(ids) - 1) + 1):
                    x, y = ids[:-d], ids[d:]
                    both = (x >= 0) & (y >= 0)
                    x, y = x[both], y[both]
                    keys += [x * size + y, y * size + x]
                    n += 2 * len(x)
                if n >= HELD:
                    yield pack()
                    keys, n = [np.zeros(0, np.int64)], 0
        if n:
            yield pack()

    return texts.select("text").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def information(counts: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """counts(i, j, n) with pmi, the positive pointwise mutual information of word i and context word j; pairs of no
    positive one are left out."""
    sums = counts.groupBy("i").agg(F.sum("n").cast("double").alias("c"))  # a row for each word of the vocabulary
    total = sums.agg(F.sum("c").alias("all"), F.sum(F.pow("c", F.lit(smoothing))).alias("smooth"))
    left = sums.crossJoin(F.broadcast(total)).select("i", (F.col("c") / F.col("all")).alias("p"), "all", (F.pow("c", F.lit(smoothing)) / F.col("smooth")).alias("q"))
    rows = counts.join(F.broadcast(left.select("i", "p", "all")), "i").join(F.broadcast(left.select(F.col("i").alias("j"), "q")), "j")
    return rows.withColumn("pmi", F.log(F.col("n") / F.col("all") / F.col("p") / F.col("q"))).where("pmi > 0").select("i", "j", "n", "pmi")


def _times(rows: DataFrame, thin: np.ndarray) -> np.ndarray:
    """The product of the matrix whose rows(i, j, x) hold their numbers as arrays with a thin matrix."""
    held = rows.sparkSession.sparkContext.broadcast(thin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.asarray(x.values) @ held.value[np.asarray(j.values)] for j, x in zip(b["j"], b["x"])]
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(out, pa.list_(pa.float64()))], ["i", "y"])

    out = np.zeros_like(thin)
    for r in rows.mapInArrow(run, "i int, y array<double>").toArrow().to_batches():  # as many rows as the vocabulary has words
        if len(r):
            out[r["i"].to_numpy()] = np.asarray(r["y"].flatten()).reshape(len(r), -1)
    held.unpersist()
    return out


@dataclass(frozen=True)
class WordVectors:
    words: list[str]
    matrix: np.ndarray

    def encoder(self, spark: SparkSession) -> WordEncoder:
        """Vectors of the words of a text: the learned one, or for other words one by their letters, which is at right
        angles to all learned ones."""
        held = spark.sparkContext.broadcast(({w: i for i, w in enumerate(self.words)}, self.matrix))

        def vectors(found: list[str]) -> np.ndarray:
            place, matrix = held.value
            out = np.zeros((len(found), matrix.shape[1] + HASHED_DIMS))
            at = np.array([place.get(w, -1) for w in found], int)
            known = at >= 0
            out[known, : matrix.shape[1]] = matrix[at[known]]
            out[~known, matrix.shape[1] :] = hashed.vectors([w for w, x in zip(found, known) if not x])
            return out

        return WordEncoder(vectors)


def fit(texts: DataFrame, size: int = VOCABULARY, window: int = WINDOW, dims: int = DIMS, seed: int = SEED) -> WordVectors:
    """Vectors of the most frequent words of texts(text); null texts have no words.  Words that are near nothing get
    none.  Without words there are no vectors."""
    spark = texts.sparkSession
    vocabulary = words(texts, size)
    if not vocabulary:
        return WordVectors([], np.zeros((0, dims)))
    path = io.scratch(spark, "near")
    weighed = information(near(texts, vocabulary, window)).orderBy("i", "j")
    # A row of the matrix is a word's, as long as the vocabulary at most.
    weighed.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "pmi"))).alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.pmi").alias("x")).write.parquet(path)
    rows = spark.read.parquet(path)
    wide = min(len(vocabulary), dims + MORE)
    basis = np.random.default_rng(seed).normal(size=(len(vocabulary), wide))
    for _ in range(ROUNDS + 1):
        basis, _ = np.linalg.qr(_times(rows, basis))
    # Smoothing makes the matrix a little uneven, so left factors come from its product with the basis of its columns.
    left, strength, _ = np.linalg.svd(_times(rows, basis), full_matrices=False)
    left, strength = left[:, :dims], strength[:dims]
    left = left * np.where(left[np.abs(left).argmax(axis=0), np.arange(left.shape[1])] < 0, -1.0, 1.0)
    matrix = left * np.sqrt(strength)
    some = np.linalg.norm(matrix, axis=1) > 1e-12
    return WordVectors([w for w, x in zip(vocabulary, some) if x], matrix[some])
