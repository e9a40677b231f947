"""Spelling variants against a plain form of the rules."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA
from turnloom.llm import spelling


def near(s, t):
    """Whether one inserted, deleted or replaced letter makes t of s."""
    if len(s) == len(t):
        return sum(x != y for x, y in zip(s, t)) == 1
    short, long = sorted((s, t), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in v.items():
        found = sorted((-v[x], x) for x in v if near(w, x))
        form = found[0][1] if found and -found[0][0] >= 2 * n else None
        out[w] = [form, None, n, len(found), v[form] if form else None]
    for w, r in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        r[1] = root
    return {w: tuple(r) for w, r in out.items()}


def corpus(seed=2):
    """Words in families of variants, with accents, repeats and capitals."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéß×") for _ in range(rng.randint(4, 9))) for _ in range(40)] + ["aaaaa", "ababab", "abababa", "bababa", "z" * 3000, "z" * 2999]
    chain = " ".join(["qqqqq"] * 90 + ["qqqqr"] * 40 + ["qqqrr"] * 15 + ["qqqr"] * 9)
    rows = [(None, None, None, None, None), (0, chain, None, None, 0), (1, "", None, None, 0), (2, "9 8 ÷÷÷÷÷ .", None, None, 0)]
    for i in range(3, 260):
        said = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.25:
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(["", w[p] + rng.choice("abé"), rng.choice("abé")]) + w[p + 1 :]
            said.append(w.title() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "-", ", "]).join(said), None, None, 0))
    return rows + [rows[5], rows[5], (None, rows[6][1], None, None, 0)]


@pytest.mark.parametrize("long", [spelling.LONG, 3])
def test_variants(spark, monkeypatch, long):
    rows = corpus()
    want = plain(rows)
    assert sum(r[0] is not None for r in want.values()) > 50 and any(want[r[0]][0] for r in want.values() if r[0])
    found = spelling.pairs
    monkeypatch.setattr(spelling, "pairs", lambda vocab: found(vocab, long))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.word: tuple(r)[1:] for r in spelling.variants(docs.selectExpr("*", "1 as word", "2 as n", "3 as g")).collect()}
    assert got == want


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a b c", None, None, 0)], SCHEMA)).count() == 0


def test_one_edit():
    rng = random.Random(4)
    for _ in range(3000):
        s, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        if s != t:
            assert spelling.one_edit(s, t) == near(s, t) == spelling.one_edit(t, s)


def test_what_is_left_without_a_letter():
    word = "abcabé"
    left = spelling.rests(word)
    assert left[0] == spelling.rests("x" + word)[1] and left[1] == spelling.rests("bcabé")[0]
    assert all(left[i + 1] == spelling.rests(word[:i] + word[i + 1 :])[0] for i in range(len(word)))
    assert len(np.unique(left)) == len(word) + 1


def test_a_word_asks_a_list_once(spark):
    """babaaaabc has its rare gram aaa at two places in a row, so it asked one list twice and its pair counted twice."""
    said = ["baabaaaabc", "babaaaabc", "babbc", "bacbccbc", "bacbccbcaab", "bacccbc", "cacaabcaabac", "cacabcaabac", "cccacbaacc"]
    rows = [(1, " ".join(3 * said), None, None, 0)]
    got = {r.word: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows) and got["babaaaabc"][3] == 1


def test_merging_asks_no_function_for_each_number():
    """A Python call for each number that was looked up made the lists half of the query's time."""
    rng = random.Random(5)
    for _ in range(500):
        lists = [sorted(rng.sample(range(12), rng.randint(1, 9))) for _ in range(rng.randint(1, 7))]
        least = rng.randint(1, 7)
        counts = Counter(x for y in lists for x in y)
        assert spelling._merged(list(lists), least) == sorted(x for x, n in counts.items() if n >= least)
    calls = Counter()
    lists = [list(range(k, 1000)) for k in range(5)]
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        found = spelling._merged(lists, 5)
    finally:
        sys.setprofile(None)
    assert found == list(range(4, 1000)) and calls["call"] < 10
