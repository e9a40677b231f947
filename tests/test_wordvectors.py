"""Learned word vectors: counts and weights against plain forms, the factors against a whole decomposition, and meaning."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import embedscore, wordvectors

#: Pairs of words that stand for each other, without a letter in common to go by.
TWINS = [("fever", "pyrexia"), ("belly", "abdomen"), ("shot", "injection"), ("tired", "weary"), ("doctor", "physician"), ("drug", "medicine")]


def talk(rng, n):
    """Sentences in which twins stand among the same neighbours, chosen freely."""
    frames = {a: [f"{a}{k}" for k in range(6)] for a, _ in TWINS}
    for _ in range(n):
        a, b = rng.choice(TWINS)
        near = rng.sample(frames[a], 4)
        yield " ".join([*near[:2], rng.choice((a, b)), *near[2:]])


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(t,) for t in talk(random.Random(1), 1500)] + [(None,), ("",)], "text string")


def test_counts_and_information(spark):
    rows = ["a b a c", "b b", "zz a", None, "c"]
    texts = spark.createDataFrame([(r,) for r in rows], "text string")
    known = wordvectors.words(texts, 3)
    assert known == ["a", "b", "c"]
    want = Counter()
    for r in rows:
        w = (r or "").split()
        want.update((x, y) for i, x in enumerate(w) for j, y in enumerate(w) if i != j and abs(i - j) <= 2 and x in known and y in known)
    counts = wordvectors.near(texts, known, 2)
    assert {(known[r.i], known[r.j]): r.n for r in counts.collect()} == dict(want)
    total, own = want.total(), Counter()
    for (x, _), n in want.items():
        own[x] += n
    smooth = sum(n**0.75 for n in own.values())
    pmi = {k: math.log(n / total / (own[k[0]] / total) / (own[k[1]] ** 0.75 / smooth)) for k, n in want.items()}
    assert {(known[r.i], known[r.j]): r.pmi for r in wordvectors.information(counts).collect()} == pytest.approx({k: v for k, v in pmi.items() if v > 0})


def test_factors_equal_those_of_the_whole_matrix(spark, corpus):
    vectors = wordvectors.fit(corpus, dims=8)
    known = wordvectors.words(corpus)
    whole = np.zeros((len(known), len(known)))
    for r in wordvectors.information(wordvectors.near(corpus, known)).collect():
        whole[r.i, r.j] = r.pmi
    strength = np.linalg.svd(whole)[1]
    assert vectors.words == known and (vectors.matrix**2).sum(axis=0) == pytest.approx(strength[:8], rel=0.02)
    basis, _ = np.linalg.qr(vectors.matrix)
    left_over = np.linalg.norm(whole - basis @ basis.T @ whole)
    assert left_over < 1.02 * np.sqrt((strength[8:] ** 2).sum())  # none of eight dimensions leave less than the root


def test_meaning(spark, corpus):
    """Planted paraphrases score above shuffled pairs with learned vectors, and not with hashes of letters."""
    rng = random.Random(2)
    lines = [rng.sample(TWINS, 3) for _ in range(30)]
    other = lines[1:] + lines[:1]
    rows = [(i, " ".join(a for a, _ in x), " ".join(b for _, b in x), " ".join(b for _, b in y)) for i, (x, y) in enumerate(zip(lines, other)) if {*x} != {*y}]
    df = spark.createDataFrame(rows, "i int, said string, meant string, shuffled string")
    vectors = wordvectors.fit(corpus, dims=16)
    again = wordvectors.fit(corpus.repartition(5), dims=16)
    assert vectors.words == again.words and vectors.matrix == pytest.approx(again.matrix, abs=1e-6)
    wins = {}
    for name, encode in (("learned", vectors.encoder(spark)), ("hashed", embedscore.hashed)):
        scored = df.select(embedscore.bertscore(F.col("said"), F.col("meant"), encode)["f1"].alias("a"), embedscore.bertscore(F.col("said"), F.col("shuffled"), encode)["f1"].alias("b")).collect()
        wins[name] = sum(r.a > r.b + 0.05 for r in scored) / len(scored)
    assert wins["learned"] > 0.95 and wins["hashed"] < 0.6


def test_words_outside_the_vocabulary(spark, corpus):
    encode = wordvectors.fit(corpus, size=10, dims=4).encoder(spark)
    p, r, f = embedscore.match(encode("unheard of"), encode("unheard of"))
    assert (p, r, f) == pytest.approx((1, 1, 1)) and encode("").shape[0] == 0
    assert wordvectors.fit(corpus.limit(0)).words == []
