"""Greedy matching of token embeddings (after Zhang et al., "BERTScore", 2020).

Encoders are pluggable.  embed_score() takes two tables of vectors by text; bertscore() takes two
columns of texts and an encoder that runs in the worker, a text at a time.  Where a word's vector is
the same in every text (WordEncoder), different words are compared once and counted.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns (id, text) rows into (id, vec) rows, a vector for each token.
Encoder = Callable[[DataFrame], DataFrame]
#: Turns a text into its token vectors (tokens by dimensions); a model may see all of the text.
TextEncoder = Callable[[str], np.ndarray]

#: Tokens of one side that are compared at once with all of the other.
BLOCK = 512
#: Dimensions of hashed().
DIMS = 256
_WORD = re.compile(r"\w+")


def match(generated: np.ndarray, reference: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall, F: means of each token's best cosine on the other side; 0 if a side is empty."""
    if not len(generated) or not len(reference):
        return 0.0, 0.0, 0.0
    g, r = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (generated, reference))
    own, other = np.empty(len(g)), np.full(len(r), -np.inf)
    for s in range(0, len(g), BLOCK):
        cosine = g[s : s + BLOCK] @ r.T
        own[s : s + BLOCK] = cosine.max(axis=1)
        np.maximum(other, cosine.max(axis=0), out=other)
    p, q = float(own.mean()), float(other.mean())
    return p, q, 2 * p * q / (p + q) if p + q else 0.0


def tokenize(text: str) -> list[str]:
    """The lower-case words of a text."""
    return _WORD.findall(text.lower())


class WordEncoder:
    """Vectors of the words of a text, each the same wherever the word stands; vectors() gives those of a list of words."""

    def __init__(self, vectors: Callable[[list[str]], np.ndarray]):
        self.vectors = vectors

    def __call__(self, text: str) -> np.ndarray:
        return self.vectors(tokenize(text))


class _Grams(dict):
    """The place that a short run of characters counts in: of the first DIMS (add 1) or of the next (take 1 off)."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = zlib.crc32(gram.encode())
        self[gram] = at = h % DIMS + (0 if h >> 31 else DIMS)
        return at


_grams = _Grams()


@lru_cache(1 << 16)
def _places(word: str) -> bytes:
    """Places of the word's character pairs and triples and of the word itself, 16 bits each."""
    marked = f"<{word}>"
    n = len(marked)
    own = _Grams.__missing__({}, marked) if n > 3 else _grams[marked]
    return array("H", [*[_grams[marked[i : i + 2]] for i in range(n - 1)], *[_grams[marked[i : i + 3]] for i in range(n - 2)], own]).tobytes()


def _hashed(words: list[str]) -> np.ndarray:
    found = [_places(w) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
    cells = np.repeat(np.arange(len(found)) * (2 * DIMS), sizes) + np.frombuffer(b"".join(found), np.uint16)
    counts = np.bincount(cells, minlength=len(found) * 2 * DIMS).reshape(len(found), 2, DIMS)
    # Small whole numbers: their products are exact in single precision too.
    return (counts[:, 0] - counts[:, 1]).astype(np.float32)


#: Vectors of the lower-case words of a text, from signed hashes of their character pairs and triples and of the
#: word: the same on every machine, and without weights, so without context or meaning.
hashed = WordEncoder(_hashed)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(np.square(vectors, dtype=float).sum(axis=1)), 1e-300)


def _best(g: np.ndarray, long_g: np.ndarray, r: np.ndarray, long_r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine of each vector of either side on the other (-inf if that has none), BLOCK at a time."""
    own, other = np.full(len(g), -np.inf), np.full(len(r), -np.inf)
    for s in range(0, len(g) if len(r) else 0, BLOCK):
        cosine = (g[s : s + BLOCK] @ r.T) / long_r
        cosine /= long_g[s : s + BLOCK, None]
        own[s : s + BLOCK] = cosine.max(axis=1)
        np.maximum(other, cosine.max(axis=0), out=other)
    return own, other


class Reference:
    """The words of a text to be matched with others: each is encoded once, whatever it is matched with."""

    def __init__(self, words: list[str], vectors: Callable[[list[str]], np.ndarray]):
        self.encode, self.counts = vectors, Counter(words)
        self.at = {w: i for i, w in enumerate(self.counts)}
        self.vectors = vectors(list(self.at))
        self.lengths = _lengths(self.vectors)
        self.n = np.fromiter(self.counts.values(), float, len(self.counts))

    def match(self, generated: list[str]) -> tuple[float, float, float]:
        """What match() gives for the vectors of these words: a word that both sides have is its own best, so only others
        are compared, each once."""
        if not generated or not self.at:
            return 0.0, 0.0, 0.0
        counts = Counter(generated)
        place = np.fromiter((self.at.get(w, -1) for w in counts), np.int64, len(counts))
        n, shared = np.fromiter(counts.values(), float, len(counts)), place[place >= 0]
        # A word whose vector has no length is at no angle to anything, as in match().
        own = (self.lengths > 1e-300).astype(float)[place]
        other = own_of = np.full(len(self.at), -np.inf)
        if (place < 0).any():
            new = self.encode([w for w, i in zip(counts, place.tolist()) if i < 0])
            own[place < 0], own_of = _best(new, _lengths(new), self.vectors, self.lengths)
        theirs = np.ones(len(self.at), bool)
        theirs[shared] = False
        if len(shared) and theirs.any():
            other = other.copy()
            other[theirs] = _best(self.vectors[theirs], self.lengths[theirs], self.vectors[shared], self.lengths[shared])[0]
        best = np.maximum(other, own_of)
        best[shared] = own[place >= 0]
        p, q = float(own @ n) / len(generated), float(best @ self.n) / self.counts.total()
        return p, q, 2 * p * q / (p + q) if p + q else 0.0


def bertscore(reference: Column, generated: Column, encode: TextEncoder = hashed) -> Column:
    """struct of precision, recall and F (p, r, f1) of two columns of texts, in one row each and without a shuffle.
    A null text has no tokens, and a side without tokens scores 0."""

    def words(reference: pd.Series, generated: pd.Series) -> Iterator[tuple[float, float, float]]:
        last = None
        for r, g in zip(reference, generated):
            if last is None or r != last:  # rows of one reference mostly follow each other
                last, found = r, tokenize(r or "")
                known = Reference(found, encode.vectors)
            yield known.match(found if g == r else tokenize(g or ""))

    @F.pandas_udf("p double, r double, f1 double")
    def score(reference: pd.Series, generated: pd.Series) -> pd.DataFrame:
        if isinstance(encode, WordEncoder):
            rows = list(words(reference, generated))
        else:
            rows = [match(encode(g or ""), encode(r or "")) for r, g in zip(reference, generated)]
        return pd.DataFrame(rows, columns=["p", "r", "f1"])

    return score(reference, generated)


#: Different vectors of a text that are compared in one row (about).
PART = 1024


def _parts(vectors: DataFrame, part: int) -> DataFrame:
    """id, part, m: the different vectors of each text and how often it has each, in parts of about `part` by hash."""
    each = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).groupBy("id", "vec").agg(F.count("*").alias("n"))
    sizes = each.groupBy("id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = each.join(sizes, "id").withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")))
    return dealt.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("vec", "n"))).alias("m"))


def embed_score(generated: DataFrame, reference: DataFrame, pairs: DataFrame, part: int = PART) -> DataFrame:
    """gen_id, ref_id, p, r, f1 of pairs(gen_id, ref_id) over (id, vec array<double>) tables; a pair one side of which has no
    vectors gives no row.

    A text's vectors are in parts, and a row compares a part of one side with one of the other: it gives the best cosine
    of each vector in either, of which the best over all parts count.  So a text may have any number of vectors."""
    g, r = _parts(generated, part), _parts(reference, part)
    rows = pairs.join(g.select(F.col("id").alias("gen_id"), F.col("part").alias("g_part"), F.col("m").alias("g")), "gen_id")
    rows = rows.join(r.select(F.col("id").alias("ref_id"), F.col("part").alias("r_part"), F.col("m").alias("r")), "ref_id")

    @F.pandas_udf("g array<double>, r array<double>")
    def best(g: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(g, r):
            x, y = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) for z in (np.stack(x), np.stack(y)))
            cosine = x @ y.T
            out.append((cosine.max(axis=1), cosine.max(axis=0)))
        return pd.DataFrame(out, columns=["g", "r"])

    found = rows.select("gen_id", "ref_id", "g_part", "r_part", best("g.vec", "r.vec").alias("b"), F.col("g.n").alias("gn"), F.col("r.n").alias("rn"))
    sides = F.array(
        F.struct(F.lit("p").alias("side"), F.col("g_part").alias("part"), F.col("b.g").alias("c"), F.col("gn").alias("n")),
        F.struct(F.lit("r").alias("side"), F.col("r_part").alias("part"), F.col("b.r").alias("c"), F.col("rn").alias("n")),
    )
    each = found.select("gen_id", "ref_id", F.inline(sides)).select("gen_id", "ref_id", "side", "part", F.posexplode(F.arrays_zip("c", "n")).alias("at", "x"))
    most = each.groupBy("gen_id", "ref_id", "side", "part", "at").agg(F.max("x.c").alias("c"), F.first("x.n").alias("n"))
    mean = lambda side: F.sum(F.when(F.col("side") == side, F.col("c") * F.col("n"))) / F.sum(F.when(F.col("side") == side, F.col("n")))
    out = most.groupBy("gen_id", "ref_id").agg(mean("p").alias("p"), mean("r").alias("r"))
    f1 = F.when(F.col("p") + F.col("r") != 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return out.select("gen_id", "ref_id", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(f1, 6).alias("f1"))
