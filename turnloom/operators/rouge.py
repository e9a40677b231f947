"""Overlap of a generated text with its reference: n-grams and longest common subsequence.

After C.-Y. Lin, "ROUGE" (2004).  A pair is scored in one row, without a shuffle, in an
Arrow batch; the subsequence by the bit-vector recurrence (Crochemore et al. 2001, Hyyro
2004) on Python's integers.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.porter import stem as porter

_TOKEN = re.compile("[a-z0-9]+")
#: Longer tokens are stemmed.
UNSTEMMED = 3
_cached = lru_cache(1 << 16)(porter)


def tokens(text: str | None, stemmed: bool = True) -> list[str]:
    found = _TOKEN.findall((text or "").lower())
    return [_cached(t) if len(t) > UNSTEMMED else t for t in found] if stemmed else found


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence.  A common beginning is part of one, and a token that only one side has is of none."""
    if not a or not b:
        return 0
    if a[: len(b)] == b or b[: len(a)] == a:
        return min(len(a), len(b))
    begun = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
    ours, theirs = set(a[begun:]), set(b[begun:])
    return begun + _lcs([t for t in a[begun:] if t in theirs], [t for t in b[begun:] if t in ours])


def _lcs(a: list[str], b: list[str]) -> int:
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for t in b:
        u = v & places.get(t, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def _ratio(hit: int, generated: int, reference: int) -> tuple[float, float, float]:
    if not hit:
        return 0.0, 0.0, 0.0
    p, r = hit / generated, hit / reference
    return p, r, 2 * p * r / (p + r)


def _ngrams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)))) if n > 1 else Counter(words)


def _clipped(a: Counter, b: Counter) -> tuple[float, float, float]:
    """Precision, recall, F of clipped counts of the reference `a` and the generated `b`."""
    if len(a) < len(b):
        hit = sum(min(n, b[t]) for t, n in a.items() if t in b)
    else:
        hit = sum(min(n, a[t]) for t, n in b.items() if t in a)
    return _ratio(hit, b.total(), a.total())


def ngram_scores(reference: list[str], generated: list[str], n: int) -> tuple[float, float, float]:
    """Precision, recall, F of clipped n-gram counts."""
    return _clipped(_ngrams(reference, n), _ngrams(generated, n))


def lcs_scores(reference: list[str], generated: list[str]) -> tuple[float, float, float]:
    return _ratio(lcs(reference, generated), len(generated), len(reference))


_FIELDS = [f"{m}_{x}" for m in ("rouge1", "rouge2", "rougeL") for x in "prf"] + ["lcs"]


def _kernel(stemmed: bool, limit: int | None):
    @F.pandas_udf(", ".join(f"{c} double" for c in _FIELDS[:-1]) + ", lcs long")
    def score(reference: pd.Series, generated: pd.Series) -> pd.DataFrame:
        rows, last = [], None
        for r, g in zip(reference, generated):
            if last is None or r != last:  # rows of one reference mostly follow each other
                last, a = r, tokens(r, stemmed)[:limit]
                ones, twos = _ngrams(a, 1), _ngrams(a, 2)
            b = tokens(g, stemmed)[:limit]
            common = lcs(a, b)
            rows.append((*_clipped(ones, _ngrams(b, 1)), *_clipped(twos, _ngrams(b, 2)), *_ratio(common, len(b), len(a)), common))
        return pd.DataFrame(rows, columns=_FIELDS)

    return score


def rouge(reference: Column, generated: Column, stemmed: bool = True, limit: int | None = None) -> Column:
    """struct of precision, recall and F of rouge1, rouge2 and rougeL, and the length of the
    common subsequence; a null text has no tokens.  limit: tokens looked at, None for all."""
    return _kernel(stemmed, limit)(reference, generated)
