"""Near-duplicates, repeats, contamination and nearest neighbours against plain forms."""

from __future__ import annotations

import hashlib
import os
import pickle
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SCHEMA, contaminated, make_docs, near_groups
from turnloom.llm import ann, decontam, minhash, sql, suffix


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, seed):
    rows = make_docs(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = near_groups(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_dense_bucket(spark):
    """A chain of texts in one bucket, neighbours linked, ends not: the residual step must find all links."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(k):
            w[(j * 5) % 200] = f"x{j}"
        rows.append((k, " ".join(w), "en", "s", 0))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: c for i, (_, c) in near_groups(rows).items()}


def test_across_finds_every_link_between_components(spark):
    """Random sets of all sizes from shared pools, each its own component or one of few."""
    rng = np.random.default_rng(1)
    sets = []
    for k in range(260):
        pool = np.random.default_rng(k % 7).integers(0, 2**62, 90)
        n = int(rng.choice([3, 9, 60, 75, 82, 90]))
        sets.append(np.unique(np.concatenate([rng.choice(pool, n, replace=False), rng.integers(0, 2**62, int(rng.integers(0, 1 + n // 6)))])))
    comp = [i if i % 3 else i % 5 for i in range(len(sets))]
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, shingles binary")
    nodes = spark.createDataFrame(list(enumerate(comp)), "id long, comp long")
    met = {tuple(r) for r in minhash.across(nodes, rows).collect()}
    every = {(i, j) for j in range(len(sets)) for i in range(j) if comp[i] != comp[j]}
    links = {(i, j) for i, j in every if minhash.linked(sets[i].view(np.uint64), sets[j].view(np.uint64))}
    assert len(links) > 50 and links <= met <= every
    assert len(met) < len(every) / 3


def test_boilerplate_makes_no_pairs(spark):
    """Sets that share half their shingles, all in one bucket: rows stay linear, pairs none."""
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**62, int(rng.integers(22, 40)))])) for _ in range(3000)]
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, shingles binary")
    assert minhash.across(rows.selectExpr("id", "id as comp"), rows).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert sorted(got) == [*range(61), *range(100, 160), 200, 201]
    assert len({got[i] for i in range(61)}) == len({got[i] for i in range(100, 160)}) == 1
    assert len(set(got.values())) == 3


def test_rows_that_share_a_doc_id_keep_their_texts(spark):
    say = lambda p: " ".join(f"{p}{i}" for i in range(40))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " more"), (3, say("b") + " more"), (4, say("c")), (4, say("c")), (4, say("c") + " x"), (5, say("d")), (None, say("d")), (6, "  "), (6, "  ")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 5), (None, None), (6, 6), (6, 6)], key=str)
    kept = sorted(((r.doc_id, r.text[:2]) for r in minhash.deduplicated(docs).collect()), key=str)
    assert kept == sorted([(1, "a0"), (1, "b0"), (4, "c0"), (5, "d0"), (None, "d0"), (6, "  "), (6, "  ")], key=str)


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as id", "3 as h", "4 as bands")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()), key=str)
    assert got == [(3, 3, True), (None, None, True), (None, None, True)]


def test_deduplicated_keeps_one_row_of_each_group(spark):
    rows = make_docs(2)
    got = minhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, (_, c) in near_groups(rows).items() if i == c)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    both = np.unique(np.concatenate([s[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    agree = (minhash.signature(s) == minhash.signature(both)).mean()
    assert abs(agree - 0.6) < 0.15
    assert (minhash.signature(s[:1]) == s[0]).all()


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted({(r[0], r[1]) for r in rows}):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats(spark, seed):
    rows = [r for r in make_docs(seed) if r[1] is not None] + [(500, "ab" * 400, None, None, 0), (501, "x" * 250, None, None, 0), (502, "é" * 120, None, None, 0)]
    rows.append(rows[9])
    got = suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain_repeats(rows)


def test_repeats_edges(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, None, None), (None, "q" * 99, None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as doc", "2 as tie", "3 as spans")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(odd).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), None: (99, 0, 0)}


def test_levels_are_suffix_arrays_and_fall_by_half():
    """Against the plain longest common prefix with everything before; bytes of all kinds, NUL among them."""
    rng = np.random.default_rng(0)
    index, seen = suffix.LogIndex(), []
    for k in range(30):
        data = rng.choice(np.array([0, 1, 97, 255], np.uint8), int(rng.integers(100, 400)))
        if k % 3 == 1:
            data = np.concatenate([data[:40], before[:150], data[40:]])  # noqa: F821
        if k % 7 == 0:
            data[:] = 0
        before = data
        at = np.arange(len(data) - suffix.SPAN + 1)
        want = []
        for p in at:
            mine = data[p : p + suffix.SPAN].tobytes()
            want.append(any(len(os.path.commonprefix([mine, x])) >= suffix.SPAN for x in seen))
            seen.append(mine)
        assert index.insert(data, at).tolist() == want
        for level in index.levels:
            s = [level.data[p : p + suffix.SPAN].tobytes() for p in level.at]
            assert s == sorted(set(s))
        sizes = [len(x.at) for x in index.levels]
        assert all(b * 2 <= a for a, b in zip(sizes, sizes[1:]))
    assert sum(sizes) == len(set(seen))


@pytest.mark.parametrize("hot", [2, 12])
def test_crowded_anchors_do_not_change_the_result(spark, monkeypatch, hot):
    """A passage with different surroundings in every document."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(4)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = say(300)
    rows = [(i, say(rng.randint(0, 90)) + passage[rng.randint(0, 9) : 290] + say(rng.randint(0, 90)), None, None, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = docs.selectExpr("doc_id as doc", "hash(text) as tie", "cast(text as binary) as text")
    assert len(suffix.crowded(texts)) > 0
    assert {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(docs.repartition(3)).collect()} == plain_repeats(rows)


def test_fingerprints_and_runs_cover_every_position(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 64)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 700).astype(np.uint8)
    offsets = np.array([0, 150, 150, 249, 349, 700])
    hot = np.unique(np.concatenate([x[3] for x in suffix.runs(data, offsets)]))[::2]
    got = set()
    for text, p, n, key, whole in suffix.runs(data, offsets, hot):
        for t, a, k in zip(text, p, n):
            assert 1 <= k <= suffix.STARTS
            got |= {(int(t), int(x)) for x in range(a, a + k)}
    assert got == {(t, x) for t in range(5) for x in range(offsets[t + 1] - offsets[t] - 99)}


ITEMS = [(1, None), (2, ""), (3, "alpha beta"), (4, "gamma"), (5, " ".join(f"k{i}" for i in range(13))), (6, " ".join(f"k{i}" for i in range(40))), (6, " ".join(f"k{i}" for i in range(40))), (70, "Ünï, alpha; beta gamma delta")]
ITEM_SCHEMA = "item_id long, text string"


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_decontamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontam, "PART_BYTES", 500)
    rows = make_docs(3)
    k = [f"k{i}" for i in range(60)]
    extra = ["x " + " ".join(k[5:25]) + " y", " ".join(k[:12]), "Alpha-BETA alpha", "gamma", " ".join(k) * 3, "ünï alpha beta gamma delta", "GAMMA " + "z " * 40]
    rows += [(1000 + i, t, None, None, 0) for i, t in enumerate(extra)]
    got = decontam.decontaminate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ITEMS, ITEM_SCHEMA)).collect()
    want = contaminated(rows, ITEMS)
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = want[r.doc_id]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert tuple(r)[1:] == (n, hit, len(found), sha, hit > 0 and 20 * hit >= n)
    kept = decontam.clean(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ITEMS, ITEM_SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in got if not r.contaminated)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([], ITEM_SCHEMA)
    docs = spark.createDataFrame([(None, "a", None, None, 1), (1, None, None, None, 0)], SCHEMA).selectExpr("*", "9 as n_words", "8 as contaminated")
    assert [r.contaminated for r in decontam.decontaminate(docs, items).collect()] == [False, False]
    assert decontam.clean(docs, items).columns == docs.columns
    assert decontam.decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, ITEM_SCHEMA)).count() == 0


def test_every_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**60, 60).astype(np.uint64), rng.integers(0, 2**60, 60).astype(np.uint64)
    b[20 : 20 + decontam.SPAN] = a[33 : 33 + decontam.SPAN]
    assert np.intersect1d(decontam.fingerprints(a), decontam.fingerprints(b)).size


def vectors(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, 16))
    x[40:70] = x[39]
    return [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]


def test_neighbours(spark):
    rows = vectors()
    bad = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] + [1.0] * 15, 0), (5060, [None] + [1.0] * 15, 0), (5080, [float("inf")] + [1.0] * 15, 0), (5100, [1.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + bad + [rows[20]], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    hit = total = 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found[:3]:
            assert s == pytest.approx(float(x[q] @ x[v]), rel=1e-12)
        s = ann.products(np.broadcast_to(x[q], x.shape), x)
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(len(s)), -s))[:20].tolist())
        hit, total = hit + len(want & {f[1] for f in found}), total + 20
    assert hit / total >= 0.9


def test_neighbours_edges(spark, monkeypatch):
    schema = "vec_id long, embedding array<float>, label int"
    assert ann.neighbours(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (7, [0.0, 0.0], 0)], schema).selectExpr("*", "1 as leaf", "2 as v")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    monkeypatch.setattr(ann, "CELL", 8)
    rows = vectors(300, 1)
    df = spark.createDataFrame(rows, schema)
    cut = sorted(map(tuple, ann.neighbours(df).collect()))
    monkeypatch.setattr(ann, "CELL", 4096)
    assert cut == sorted(map(tuple, ann.neighbours(df).collect()))


def test_items_without_id_hit(spark):
    """As the registered SQL has it: all null ids are one item, and the digest leaves it out."""
    rows = [(1, "a b c", None, None, 0), (2, "d e", None, None, 0), (3, "a b c d e f g", None, None, 0), (4, "x", None, None, 0)]
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(None, "b c"), (None, "d e"), (7, "f g")], ITEM_SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in decontam.decontaminate(docs, items).collect()}
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in ("", "7")}
    assert got == {1: (3, 2, 1, sha[""], True), 2: (2, 2, 1, sha[""], True), 3: (7, 6, 2, sha["7"], True), 4: (1, 0, 0, sha[""], False)}
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar); create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    con.executemany("insert into benchmark values (?, ?)", [(None, "b c"), (None, "d e"), (7, "f g")])
    assert got == {r[0]: r[1:] for r in con.execute(sql.DECONTAMINATION).fetchall()}
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [4]


def test_queries_in_small_leaves_get_all_neighbours(spark, monkeypatch):
    """With a width of one leaf, queries among few rows far from a dense cluster went short."""
    monkeypatch.setattr(ann, "_calibrated", lambda *a: 1)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.01, (600, 6)) + 1, rng.normal(0, 0.01, (5, 6)) - 9, rng.normal(0, 0.01, (5, 6)) * 3 + [9, -9, 9, -9, 9, -9]])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(600, x[600].tolist())] * 30
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=5).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 20 for i in range(0, 610, 5)}


def test_index_of_a_large_benchmark_is_small():
    """A block of 16 MB may take 150 MB of a worker; here a quarter of it."""
    rng = np.random.default_rng(4)
    vocab = [f"w{i}".encode() for i in range(20_000)]
    texts = [b" ".join([vocab[i] for i in rng.integers(0, len(vocab), 400)]) for _ in range(1750)]
    size = sum(map(len, texts))
    assert size > 3.9e6
    index = decontam.Index((str(i), t) for i, t in enumerate(texts))
    assert len(pickle.dumps(index)) < 150 / 16 * size and index.nbytes() < 32 * sum(len(decontam.words(t)) for t in texts)
    got = next(decontam.scan([texts[7][:3000] + b" none of these " + texts[9]], index, decontam.WordHash()))
    assert got[2] == ["7", "9"] and got[3] >= 400


def test_spans_that_overlap():
    assert decontam.together([5, 9, 0, 3, 3, 4, 8, 12, 20, 21]) == [0, 4, 5, 12, 20, 21]
    assert decontam.together([]) == []
