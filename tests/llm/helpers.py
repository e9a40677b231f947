"""Small fixtures and plain forms of the operators' rules."""

from __future__ import annotations

import collections
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())


def words(t):
    return WORD.findall(low(t))


def make_docs(seed=0, n=60):
    """Texts with exact and near copies, shared passages, nulls, blanks, a long one, and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéfghij", k=rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = say(60)
    texts = [None, "", "   \n", "one", "one two three", "One two three", say(4)]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3 or len(texts) < 15:
            texts.append(say(rng.randint(5, 80)))
        elif kind < 0.5:
            texts.append(rng.choice(texts[7:]))
        elif kind < 0.75:
            w = rng.choice(texts[7:]).split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        else:
            texts.append(say(rng.randint(0, 30)) + " " + shared[: rng.randint(50, 300)] + " " + say(rng.randint(0, 30)))
    texts.append(say(6000))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), 0 if t is None else len(t)) for i, t in zip(ids, texts)]
    return rows + [rows[10], rows[20]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_groups(rows):
    """{doc_id: (set size, component)}"""
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def contaminated(rows, items):
    """{doc_id: (n_words, n_hit, items)}"""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    spans = collections.defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if n else ():
            spans[tuple(w[j : j + n])].add(str(item))
    out = {}
    for i, t, *_ in rows:
        w = split(t)
        hit, found = set(), set()
        for n in {len(s) for s in spans}:
            for j in range(len(w) - n + 1):
                if who := spans.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= who
        out[i] = (len(w), len(hit), found)
    return out
