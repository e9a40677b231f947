"""The queries of language ID and toxicity against plain forms of everything they do."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA
from tests.llm.test_rows import gram_counts, plain_nats, write
from turnloom.llm import langid, queries, toxicity


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def test_language_id_is_the_least_code_length(spark, tmp_path):
    rng = random.Random(11)
    letters = {"a": "abcd ", "b": "abce ", "c": "bcdé "}
    rows = []
    for i in range(70):
        lang = rng.choice(list(letters))
        rows.append((i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 14))), lang, None, 0))
    rows += [(100, "ab" * 40, None, None, 0), (101, "1 2", "a", None, 0), (102, None, "a", None, 0), (None, "bad cab", "b", None, 0), rows[3], rows[3]]
    trees = {}
    for lang in letters:
        learned = {(i, t) for i, t, x, *_ in rows if x == lang and t is not None and crc(i) % 5 != 0}  # of equal rows one
        trees[lang] = gram_counts([t.encode() for _, t in learned], langid.DEPTH)
    got = queries.QUERIES["op5_langid"](spark, write(spark, tmp_path, documents=spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        t = text[r.doc_id]
        assert r.held_out == (crc(r.doc_id) % 5 == 0)
        if t is None or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        bits = {lang: plain_nats(c, t.encode(), langid.DEPTH, False) / math.log(2) for lang, c in trees.items()}
        least = min(bits.values())
        assert r.score == pytest.approx(1 / sum(2 ** (least - b) for b in bits.values()))
        assert bits[r.lang_pred] == pytest.approx(least)


def plain_toxicity(positive, unlabelled, prior):
    """Features, weights and bias by the stated rules, over dense matrices."""
    words = lambda t: {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[A-Za-z]+", t)}
    held = lambda t: {f for w in words(t) for f in [w + "$", *(w[:k] for k in (3, 4, 5, 6) if len(w) > k)]}
    p, u = [held(t) for t in positive], [held(t) for t in unlabelled]
    in_p, in_u = (Counter(f for s in x for f in s) for x in (p, u))
    names = []
    for f, n in in_p.items():
        expected = len(p) / len(u) * in_u[f]
        if n > toxicity.LEAST_MORE and n >= expected + toxicity.LEAST_DEVIATIONS * expected**0.5 + toxicity.LEAST_MORE:
            names.append(f)
    names.sort()
    x, y = (np.array([[f in s for f in names] for s in rows], float).reshape(len(rows), len(names)) for rows in (p, u))
    sigmoid = lambda g: 1 / (1 + np.exp(-g))

    def learned(prior):
        w, b = np.zeros(len(names)), math.log(prior / (1 - prior))
        m = v = np.zeros(len(names) + 1)
        for k in range(1, 401):
            gp, gu = x @ w + b, y @ w + b
            negative = np.log1p(np.exp(gu)).mean() - prior * np.log1p(np.exp(gp)).mean()
            slope_u, slope_p = sigmoid(gu) / len(u), prior * sigmoid(gp) / len(p)
            down = np.append(y.T @ slope_u - x.T @ slope_p, slope_u.sum() - slope_p.sum())
            up = -prior * sigmoid(-gp) / len(p)
            grad = -down if negative < 0 else down + np.append(x.T @ up, up.sum())
            grad[:-1] += 0.3 / len(p) * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return w, b

    w, b = learned(prior)
    if (most := toxicity.most_prior(x @ w + b, y @ w + b)) < prior:
        w, b = learned(most)
    kept = {f: z for f, z in zip(names, w) if abs(z) >= toxicity.LEAST_WEIGHT}
    return lambda t: float(sigmoid(b + sum(kept.get(f, 0.0) for f in held(t or ""))))


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_toxicity_is_the_least_risk(spark, tmp_path, share):
    """share: of toxic texts that are labelled so; the labels say more or less than the corpus holds."""
    rng = random.Random(13)
    clean, bad = [f"{a}{b}" for a in ("lun", "mar", "tel", "ost") for b in ("a", "ero", "inda", "estos")], ["vilest", "grumble", "Zot"]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        said = rng.choices(clean, k=rng.randint(3, 12)) + (rng.choices(bad, k=rng.randint(1, 3)) if toxic else [])
        rows.append((i, " ".join(rng.sample(said, len(said))) + f" {i}.", None, None, 0))
        if rng.random() < (share if toxic else 0.95):
            labels.append((i, int(toxic)))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (902, "vilest ZOT", None, None, 0)]
    d = write(spark, tmp_path, documents=spark.createDataFrame(rows, SCHEMA), labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    seen = {i: x for i, x in labels if crc(i) % 4 != 2}
    positive = sorted({t for i, t, *_ in rows if seen.get(i) == 1})
    unlabelled = sorted({t for i, t, *_ in rows if t is not None and crc(i) % 4 != 2})
    want = plain_toxicity(positive, unlabelled, min(0.5, max(0.001, sum(seen.values()) / len(seen))))
    got = queries.QUERIES["op7_toxicity"](spark, d).collect()
    text = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        s = want(text[r.doc_id])
        assert (r.held_out, r.score) == (crc(r.doc_id) % 4 == 2, pytest.approx(s, abs=1e-6))
        assert r.predicted == int(r.score >= 0.3)
    assert any(r.predicted for r in got) and not all(r.predicted for r in got)
