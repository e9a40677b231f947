"""Alignment of two tokenizers against byte ranges compared one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, make_docs
from turnloom.llm import align


def _files():
    return align.public_file("byte_bpe_50k.json"), align.public_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(_files()[0])
    one.encode_special_tokens = True
    other = SentencePieceProcessor(model_file=_files()[1])
    letters = {c: bytes([b]) for c, b in align._letters().items()}
    names = {i: w for w, i in one.get_vocab(with_added_tokens=False).items()}
    bytes_a = lambda i: b"".join(letters[c] for c in names[i])
    piece = lambda i: bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, bytes_a(i)) for i in one.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in other.encode(t)]


def plain(rows, sides):
    found, df = [], Counter()
    for doc, t, *_ in rows:
        a, b = (side(t) for side in sides) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append((doc, 0, 0, 0, [], ""))
            continue
        ends = [list(accumulate(len(x) for _, x in s)) for s in (a, b)]
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(s, es) if last < e <= cut) for s, es in zip((a, b), ends)))
            last = cut
        links = []
        spans = [list(zip([0, *es], es)) for es in ends]
        j = 0
        for (i, _), (s, e) in zip(a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            links += [(i, b[k][0]) for k in range(j, min(j + e - s + 1, len(b))) if spans[1][k][0] < e]
        df.update(set(links))
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (i, _), n in df.items():
        most[i] = max(most[i], n)
    return sorted(((d, x, y, g, len(links), sum(df[p] == most[p[0]] for p in links), sum(df[p] for p in links), h) for d, x, y, g, links, h in found), key=str)


ODD = ["<|endoftext|> and </s> <s>", "a▁b", "\x00 nul", "tab\t  two  spaces\n\n\nlines ", " ", "   ", "日本語のテキスト🙂", "'s'll I've", "x" * 3000, "ab" * 2000, "é" * 500, "́ combining", "1234567890" * 30]


@pytest.mark.parametrize("head", [align.HEAD, 40])
def test_tokens(spark, sides, head):
    rows = [r for r in make_docs(n=30)][:40] + [(1000 + i, t, None, None, 0) for i, t in enumerate(ODD)] + [(None, "no id here", None, None, 0)]
    rows += [rows[12], rows[12]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = align.tokens(docs.selectExpr("*", "1 as row", "2 as pairs", "3 as n"), *_files(), head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, sides)


def test_no_rows(spark):
    assert align.tokens(spark.createDataFrame([], SCHEMA)).count() == 0
    got = align.tokens(spark.createDataFrame([(1, None, None, None, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_transducer_over_random_cuts():
    """Vocabularies of short byte strings, a text cut at random on either side; few steps remembered."""
    rng = random.Random(7)
    words = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4) for _ in range(3)] + [b"a", b"b"]
    machine = align.Transducer(words, words)
    for _ in range(300):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)))

        def cut():
            out, at = [], 0
            while at < len(text):
                i = rng.choice([i for i, w in enumerate(words) if text.startswith(w, at)])
                out.append(i)
                at += len(words[i])
            return out

        a, b = cut(), cut()
        ends = [[0, *accumulate(len(words[i]) for i in s)] for s in (a, b)]
        ends_a, ends_b, links = align.traced(machine.run(a, b), np.array(a, np.int64), np.array(b, np.int64)) if a else ((), (), ())
        assert [ends[0][i] for i in ends_a] == sorted((set(ends[0]) & set(ends[1])) - {0}) == [ends[1][j] for j in ends_b]
        want = [a[i] << align.BITS | b[j] for i in range(len(a)) for j in range(len(b)) if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]]
        assert sorted(links) == sorted(want)
    assert machine.size and len(machine.states) < 200
    machine._forget()
    assert machine.size == 0


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 36, 1000))
    times = np.arange(len(keys)) + 1
    back = align._unpacked(align._packed(keys, times), len(keys))
    assert (back[0] == keys).all() and (back[1] == times).all()


def test_faster_encoder_gives_the_same_ids():
    """The ranks of the merges and the merges themselves, over letters of all kinds."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(_files()[0])
    whole.encode_special_tokens = True
    with open(_files()[0], "rb") as f:
        encode, _ = align.byte_level(f.read())
    for low in range(0, 0x20000, 0x101):
        c = chr(low) if not 0xD800 <= low < 0xE000 else "x"
        text = f"a{c}b {c}1 {c}{c}  {c} 's{c}"
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
