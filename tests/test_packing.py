"""Byte-pair merging against a plain loop, and packing against best fit text by text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import bpe
from turnloom.operators import packing


def vocabulary():
    """Bytes, and merges of small words in an order of their own."""
    ranks = {bytes([b]): b for b in range(256)}
    for w in (b"ab", b"aa", b"abc", b"aaaa", b"bca", b" a", b" ab", b"\xc3\xa9", b"cab", b"aab", b"abcab", b"bb", b"bbbb"):
        ranks[w] = len(ranks)
    return ranks


def naive(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_equals_a_plain_loop():
    ranks, rng = vocabulary(), random.Random(1)
    merges = bpe.Merges(ranks)
    for _ in range(3000):
        piece = bytes(rng.choice(b"aaabbc \xc3\xa9") for _ in range(rng.randint(1, 30)))
        assert merges.merged(piece) == (naive(piece, ranks) if piece not in ranks else [ranks[piece]])


def test_long_piece_is_not_quadratic():
    merges = bpe.Merges(vocabulary())
    assert len(merges.encode("a" * 200_000)) == 50_000


def test_texts_and_special_strings():
    merges = bpe.Merges(vocabulary(), {"<x>": 900, "<xy>": 901})
    assert merges.encode("ab<xy> ab<x>") == [256, 901, 262, 900]
    assert merges.encode(None) == merges.encode("") == []
    with pytest.raises(ValueError, match="lacks bytes"):
        bpe.Merges({b"a": 0})


def test_public_vocabulary(spark):
    """Ids of a public encoder over its own file."""
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = str(tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    whole = tiktoken.Encoding("x", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello there, I'm  a patient.\n\nDoctor: yes — 12,345 mg…", "é日本語🙂 naïve\t\tx", "", "a" * 500, "supercalifragilistic" * 20]
    t = packing.Tokenizer(spark, path)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, text string")
    got = {r.i: (list(r.ids), r.n) for r in rows.select("i", t.ids(F.col("text")).alias("ids"), t.count(F.col("text")).alias("n")).collect()}
    assert got == {i: (whole.encode_ordinary(x), len(whole.encode_ordinary(x))) for i, x in enumerate(texts)} | {len(texts): ([], 0)}
    chat = packing.Tokenizer.of_chat(spark, path)
    said = spark.createDataFrame([("<|im_start|>user\nhi<|im_end|>\n",)], "t string").select(chat.ids(F.col("t"))).first()[0]
    assert said[0] == len(ranks) + 1 and said[-2] == len(ranks) + 2 and len(said) == 6


def best_fit(lengths, capacity):
    """Text by text: longest first, into the fullest bin that takes it."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = {n: rng.choice([1, 2, 3, 50]) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(40, capacity)))}
    slots = packing.plan(counts, capacity)
    used = [0] * slots.bins
    taken = {n: 0 for n in counts}
    for i, (length, start, first, each, offset) in enumerate(zip(slots.length, slots.start, slots.first, slots.each, slots.offset)):
        stop = slots.start[i + 1] if i + 1 < len(slots.start) and slots.length[i + 1] == length else counts[int(length)]
        assert start == taken[int(length)]
        taken[int(length)] = int(stop)
        for k in range(int(stop - start)):
            b = int(first + k // each)
            assert used[b] == offset + k % each * length
            used[b] += int(length)
    assert taken == counts and max(used) <= capacity
    assert sorted(capacity - u for u in used) == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)
    with pytest.raises(ValueError):
        packing.plan({0: 1}, capacity)


def test_pack(spark):
    """A length that a third of all texts have, texts longer than a bin, empty ones; ranks in small groups."""
    rng = random.Random(9)
    lengths = [rng.choice([7, rng.randint(1, 60), rng.randint(1, 60)]) for _ in range(900)] + [100, 64, 65, 1000, 0]
    rows = [(f"n{i}", n) for i, n in enumerate(lengths)] + [("none", None)]
    texts = spark.createDataFrame(rows, "note_id string, n_tokens long")
    out = packing.pack(texts, 64, group=25)
    placed = out.collect()
    assert sorted(tuple(r) for r in placed if r.bin_id is None) == [("n904", 0, None, None, 0), ("none", 0, None, None, 0)]
    bins, whole = {}, {}
    for r in placed:
        whole[r.note_id] = whole.get(r.note_id, 0) + r.n_tokens
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.offset, r.n_tokens))
    assert whole == {k: n or 0 for k, n in rows}
    parts = []
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
            parts.append(n)
        assert at <= 64
    assert sorted(bins) == list(range(len(bins))) and len(bins) == len(best_fit(parts, 64))
    assert sorted(map(tuple, packing.pack(texts.repartition(7), 64, group=400).where("bin_id is not null").groupBy("bin_id").sum("n_tokens").collect())) == sorted((b, sum(n for _, n in h)) for b, h in bins.items())
    f = packing.fill(out, 64).first()
    assert (f.n_bins, f.n_parts, f.n_tokens) == (len(bins), len(placed), sum(lengths)) and f.fill == round(sum(lengths) / len(bins) / 64, 6)
    assert packing.pack(texts.limit(0)).count() == 0


def test_sequences(spark):
    rows = [("a", list(range(10))), ("b", [50, 51, 52]), ("c", [60]), ("d", [])]
    ids = spark.createDataFrame(rows, "note_id string, ids array<int>")
    placed = packing.pack(ids.select("note_id", F.size("ids").alias("n_tokens")), 6)
    got = packing.sequences(placed, ids, 6).collect()
    assert sorted(x for r in got for x in r.ids) == sorted(x for _, v in rows for x in v)
    for r in got:
        assert r.n_tokens == len(r.ids) <= 6 and r.starts[0] == 0
    whole = {tuple(r.ids[s:e]) for r in got for s, e in zip(r.starts, [*r.starts[1:], len(r.ids)])}
    assert whole == {tuple(range(6)), tuple(range(6, 10)), (50, 51, 52), (60,)}


def test_counts_hold_no_ids(spark, sf_dir):
    """Texts are counted where they are read: no array of token ids leaves a worker."""
    from turnloom.plans.registry import QUERIES

    counts = QUERIES["token_counts"](spark, sf_dir)
    assert counts.schema.simpleString() == "struct<note_id:string,n_tokens:bigint>"
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "count(" in plan and "encode(" not in plan
