"""Continuation from a corpus against a plain search, and the verdicts that follow from it."""

from __future__ import annotations

import random
import re

import pytest

from turnloom.operators import contamination, continuation


def plain(texts, corpus, depth, least):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    out = {}
    for name, t in texts:
        own, best = split(t), None
        for note, told in corpus:
            w = split(told)
            for p in range(least, len(w)):
                n = 0
                while n < min(depth, len(own), p) and own[-1 - n] == w[p - 1 - n]:
                    n += 1
                if n >= least and (best is None or (-n, note, p) < best[:3]):
                    best = (-n, note, p, " ".join(w[p : p + 5]))
        out[name] = (-best[0], best[3]) if best else (0, "")
    return out


@pytest.mark.parametrize("seed, depth, least", [(1, 16, 2), (2, 3, 2), (3, 5, 1), (4, 2, 2)])
def test_longest_end(spark, seed, depth, least):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(n))
    corpus = [(f"n{i:02d}", say(rng.randint(0, 40))) for i in range(12)] + [("none", None), ("empty", "")]
    texts = [(f"q{i}", say(rng.randint(0, 12))) for i in range(30)]
    texts += [("copy", " ".join(corpus[3][1].split()[:20])), ("other", "x y z"), ("null", None), ("end", corpus[5][1])]
    got = continuation.continued(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(corpus, "note_id string, text string"), 5, depth, least)
    assert {r.id: (r.n_shared, r.generated) for r in got.collect()} == plain(texts, corpus, depth, least)


def test_nothing_to_continue(spark):
    texts, corpus = spark.createDataFrame([("q", "a b")], "id string, text string"), spark.createDataFrame([("n", "a b c")], "note_id string, text string")
    assert continuation.continued(texts.limit(0), corpus).count() == 0
    assert [tuple(r) for r in continuation.continued(texts, corpus.limit(0)).collect()] == [("q", 0, "")]


def test_verdicts(spark):
    """A corpus that holds the dialogues is found out; one of other words is not."""
    rng = random.Random(6)
    talk = lambda k: "\n".join(f"{'Doctor' if i % 2 == 0 else 'Patient'}: " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(12)) for i in range(k))
    seen = [(f"n{i:02d}", talk(6)) for i in range(15)]
    rows = spark.createDataFrame(seen, "note_id string, conversation string")
    other = spark.createDataFrame([(f"o{i:02d}", talk(6)) for i in range(15)], "note_id string, text string")
    own = rows.selectExpr("note_id", "conversation as text")
    for corpus, says in ((own, "substantial"), (other, "not detected")):
        probe = contamination.probe(rows, n=None, continue_all=contamination.from_corpus(corpus))
        assert contamination.verdict(contamination.delta(probe, resamples=60)).first().verdict == says


def test_only_asked_places_leave_a_note(spark):
    """A place takes its own words along and not the whole note, and places that no text asks for stay where they are."""
    note = " ".join(f"w{i}" for i in range(3000))
    corpus = spark.createDataFrame([("n", note), ("m", None)], "note_id string, text string")
    wanted = continuation._bit_map(spark.createDataFrame([("w10 w11",), ("w2998 w2999",)], "text string").selectExpr("crc32(cast(text as binary)) as h"))
    assert wanted.nbytes == 1 << continuation.BITS - 3
    assert [(r.note_id, r.place, r.end) for r in continuation._places(corpus, wanted, 3, 2).collect()] == [("n", 12, "w11 w10 w9 ")]
    plan = continuation.matches(corpus.selectExpr("note_id as id", "text"), corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
