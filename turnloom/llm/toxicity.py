"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the distinct words of a text (each with its first three to six
letters) is trained in numpy from confirmed toxic texts and unlabelled ones with the
class-prior-corrected, non-negative risk

    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

on a bounded sample of training rows, with the logistic loss, so that the classifier's margin is
the log odds of being toxic.  Features are those of the sample that are over-represented in
the confirmed texts; small weights are dropped, so long clean texts do not add up to anything.
Rows labelled 0 give the class prior (the share of 1 among the labels, or less where the margins
of unlabelled texts show that it is less) and nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import small_batches, trimmed

#: Bounds of the fitting sample: confirmed texts, unlabelled texts, bytes of one.
MAX_POSITIVE, MAX_UNLABELLED, MAX_DOC_BYTES = 3000, 9000, 1 << 15
THRESHOLD = 0.3
#: A feature must be in more confirmed texts than its share in unlabelled ones lets expect,
#: by this many and this many deviations besides.
LEAST_MORE, LEAST_DEVIATIONS = 4, 4.0
PREFIXES = (3, 4, 5, 6)
#: Weights below this are dropped.
LEAST_WEIGHT = 0.25
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_TABLE).split())


def features(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:k] for k in PREFIXES if len(word) > k)]


class Model:
    """Sum over distinct features of a text, through a logistic link."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[bytes | None], seen: dict[bytes, tuple]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(texts, seen), -40, 40)))

    def margins(self, texts: list[bytes | None], seen: dict[bytes, tuple]) -> np.ndarray:
        """seen: what words were found to hold, kept between calls up to a bound."""
        g = np.full(len(texts), self.bias)
        weights = self.weights
        for i, t in enumerate(texts):
            hit: set[bytes] = set()
            for w in words(t):
                f = seen.get(w)
                if f is None:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    f = seen[w] = tuple(x for x in features(w) if x in weights)
                if f:
                    hit.update(f)
            g[i] += sum(weights[x] for x in sorted(hit))
        return g


def _features(text: bytes | None, among: dict | None = None) -> set[bytes]:
    return {f for w in words(text) for f in features(w) if among is None or f in among}


Part = tuple[np.ndarray, np.ndarray, int]  # (row, feature) of what rows hold, and the number of rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _margins(theta: np.ndarray, part: Part) -> np.ndarray:
    rows, cols, size = part
    return theta[-1] + np.bincount(rows, theta[cols], size)


def negative_risk(theta: np.ndarray, positive: Part, unlabelled: Part, prior: float) -> float:
    """E_unl[l(-g)] - prior * E_pos[l(-g)] with l(g) = log(1 + exp(-g)): what must not fall below 0."""
    gp, gu = _margins(theta, positive), _margins(theta, unlabelled)
    return float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())


def risk(theta: np.ndarray, positive: Part, unlabelled: Part, prior: float) -> float:
    """The non-negative risk; theta: a weight for each feature, then the bias."""
    return float(prior * np.logaddexp(0, -_margins(theta, positive)).mean()) + max(0.0, negative_risk(theta, positive, unlabelled, prior))


def descent(theta: np.ndarray, positive: Part, unlabelled: Part, prior: float) -> np.ndarray:
    """Gradient of the risk where its second part is not negative; else that part's, turned about, so that it rises again."""
    gp, gu = _margins(theta, positive), _margins(theta, unlabelled)

    def back(part: Part, slope: np.ndarray) -> np.ndarray:
        rows, cols, _ = part
        return np.append(np.bincount(cols, slope[rows], len(theta) - 1), slope.sum())

    # The slope of l(g) is -sigmoid(-g), that of l(-g) sigmoid(g).
    as_negative = back(unlabelled, _sigmoid(gu) / len(gu)) - back(positive, prior * _sigmoid(gp) / len(gp))
    if negative_risk(theta, positive, unlabelled, prior) < 0:
        return -as_negative
    return back(positive, -prior * _sigmoid(-gp) / len(gp)) + as_negative


def most_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """What the class prior is at most, by margins: above any cut-off, unlabelled texts cannot be rarer than the
    prior times the confirmed ones there.  Two deviations are added; cut-offs that three tenths of the
    confirmed texts reach are tried."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.7, 50), method="lower"))
    p, u = ((x[:, None] >= cuts).mean(axis=0) for x in (positive, unlabelled))
    n = len(unlabelled)
    return float(((u + 2 * np.sqrt(np.maximum(u, 1 / n) * (1 - u) / n)) / p).min())


def minimised(parts: list[Part], n: int, prior: float, steps: int, rate: float, ridge: float) -> np.ndarray:
    """Full-batch Adam on the risk above."""
    theta = np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, steps + 1):
        grad = descent(theta, *parts, prior)
        grad[:n] += ridge * theta[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta


def train(positive: list[bytes], unlabelled: list[bytes], prior: float, steps: int = 400, rate: float = 0.05, pull: float = 0.3) -> Model:
    """The least risk under a pull of weights to 0 that loses force with the number of confirmed texts.  Labelled rows may
    hold more toxic texts than the corpus does: if the margins show that the prior is too high, the
    risk is minimised again with the one they allow.  Features of a text are made anew in each pass and kept
    as numbers of the chosen ones only."""
    df_p: Counter = Counter()
    for t in positive:
        df_p.update(_features(t))
    df_p = {f: n for f, n in df_p.items() if n > LEAST_MORE}
    df_u: Counter = Counter()
    for t in unlabelled:
        df_u.update(_features(t, df_p))
    ratio = len(positive) / max(1, len(unlabelled))
    names = sorted(f for f, n in df_p.items() if n >= (e := ratio * df_u[f]) + LEAST_DEVIATIONS * e**0.5 + LEAST_MORE)
    place = {f: i for i, f in enumerate(names)}
    n = len(names)
    parts = []
    for texts in (positive, unlabelled):
        cols = [np.array(sorted(place[f] for f in _features(t, place)), np.int32) for t in texts]
        parts.append((np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols).astype(np.int64), len(cols)))
    ridge = pull / len(positive)
    theta = minimised(parts, n, prior, steps, rate, ridge)
    if (most := most_prior(*(_margins(theta, x) for x in parts))) < prior:
        theta = minimised(parts, n, most, steps, rate, ridge)
    return Model({f: float(theta[i]) for i, f in enumerate(names) if abs(theta[i]) >= LEAST_WEIGHT}, float(theta[n]))


def _sample(texts: DataFrame, most: int, salt: str) -> list[bytes]:
    """About `most` texts at most, different ones, drawn by a hash of the text alone: rows without an id,
    or many with one, are drawn like others."""
    n = texts.count()
    chance = F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    drawn = texts.where(chance < min(1.0, most / max(1, n))).select("text").distinct().toArrow()["text"].to_pylist()
    return sorted(drawn, key=lambda t: xxhash.xxh64_digest(t))[:most]


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Model of docs(doc_id, text) from labels(doc_id, toxic) where `learn` holds; one that says 0 if nothing is confirmed.

    Rows with a null doc_id have no label and count as unlabelled; null and longer texts than
    MAX_DOC_BYTES are not learned from.  A doc_id labelled more than once is toxic if one label says
    so; of equal texts one is learned from.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy(F.col("toxic") == 1).count().collect()}
    if not counts.get(True):
        return Model({}, -40.0)
    prior = min(0.5, max(0.001, counts[True] / sum(counts.values())))
    texts = docs.where(learn & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_DOC_BYTES))
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    positive = _sample(texts.join(marked.where("toxic = 1").select("doc_id"), "doc_id", "left_semi"), MAX_POSITIVE, "toxic sample")
    unlabelled = _sample(texts, MAX_UNLABELLED, "unlabelled sample")
    return train(positive, unlabelled, prior) if positive and unlabelled else Model({}, -40.0)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns of `keep`, score and predicted of every row of docs.

    A null or empty text has the score of a text without any known feature.  Repeated
    rows are answered one by one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for b in batches:
            s = held.value.scores(b["text"].to_pylist(), seen)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", *keep)), pa.array(s), pa.array((s >= THRESHOLD).astype(int), pa.int32())], ["doc_id", *keep, "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(trimmed(run), ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", score double, predicted int")
