from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.operators import arms, compare, contamination, continuation, dataset, embedscore, order, retrieval, stats
from turnloom.operators.rouge import lcs, lcs_scores, ngram_scores, rouge, tokens
from turnloom.plans import registry
from turnloom.sources import io


def ids(spark, n):
    return spark.createDataFrame([(f"note-{i:04d}",) for i in range(n)], "note_id string")


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "a", "x"), (0, "a", "y"), (1, "b", "z")], "ord int, data string, conversation string")
    assert {(r.ord, r.conversation) for r in dataset.deduplicated(df, "data", "ord").collect()} == {(0, "y"), (1, "z")}
    assert [(r.ord, r.kept) for r in dataset.dropped(df, "data", "ord").collect()] == [(2, 0)]


def test_records_ignore_malformed_copies(spark):
    df = spark.createDataFrame([(0, "n", "pre\nDoctor: a\nPatient: b"), (1, "n", "no marker")], "ord int, data string, conversation string")
    r = dataset.records(df, "ord").first()
    assert (r.conversation, r.num_turns, r.num_doctor_turns, r.num_patient_turns, r.preamble_stripped) == ("Doctor: a\nPatient: b", 2, 1, 1, True)


def test_split_sizes_and_determinism(spark):
    one = {r.note_id: r.split for r in dataset.split(ids(spark, 100)).collect()}
    two = {r.note_id: r.split for r in dataset.split(ids(spark, 100).repartition(7)).collect()}
    assert one == two and len(one) == 100
    assert sorted(list(one.values()).count(s) for s in ("train", "val", "test")) == [10, 10, 80]
    assert dataset.overlap(dataset.split(ids(spark, 50))).first().n_overlap == 0
    # 5 * 0.5 rounds to the even 2.
    half = dataset.split(ids(spark, 5), fractions={"a": 0.5, "b": 0.5})
    assert half.where("split = 'a'").count() == 2


def test_shuffled_split_on_the_driver():
    got = dataset.split_like_mt19937([f"n{i}" for i in range(50)])
    assert [len(v) for v in got.values()] == [40, 5, 5] and len(set().union(*got.values())) == 50


@pytest.mark.parametrize("n", [2, 3, 20, 500])
def test_successors_are_one_cycle(spark, n):
    rows = order.successors(ids(spark, n).withColumn("c", F.col("note_id")), "note_id", ["c"], 42).collect()
    step = {r.note_id: r.next_c for r in rows}
    at, seen = rows[0].note_id, set()
    while at not in seen:
        seen.add(at)
        at = step[at]
    assert len(seen) == n and all(k != v for k, v in step.items())


def test_successor_of_one_raises(spark):
    with pytest.raises(Exception, match="at least 2 records"):
        order.successors(ids(spark, 1).withColumn("c", F.col("note_id")), "note_id", ["c"], 42).collect()


@pytest.mark.parametrize("seed", range(25))
def test_cycle_on_the_driver(seed):
    items = list(range(100))
    got = order.cycle_like_mt19937(items, seed)
    assert sorted(got) == items and all(a != b for a, b in zip(got, items)) and got == order.cycle_like_mt19937(items, seed)


def test_cycle_of_one_raises():
    with pytest.raises(ValueError, match="at least 2 records"):
        order.cycle_like_mt19937([1], 0)


def test_generator_hook(spark):
    import pyarrow as pa

    def shout(batches):
        for b in batches:
            said = ["Doctor: " + n.upper() for n in b["clinical_note"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["note_id"], pa.array(said), pa.array([len(x.split()) for x in said], pa.int64())], ["note_id", "generated", "gen_tokens"])

    rows = spark.createDataFrame([("n1", "age 5", "Doctor: a")], "note_id string, clinical_note string, conversation string")
    made = arms.mapped(shout)(rows)
    assert tuple(made.first()) == ("n1", "Doctor: AGE 5", 3)
    assert arms.run(rows, {"shout": arms.mapped(shout)}).first().numeric_grounding_recall == 1.0
    assert arms.throughput(made, "gen_tokens")["tokens_per_second"] > 0


def test_ranks_follow_the_hash_order(spark):
    df, n = order.ranked(ids(spark, 300), "note_id", 1)
    got = [r.note_id for r in df.orderBy("rank").collect()]
    assert n.first().n == 300
    assert got == [r.note_id for r in ids(spark, 300).orderBy(order.hashed(1, F.col("note_id"))).collect()]


def test_first_n(spark):
    assert order.first_n(ids(spark, 30), "note_id", 7, 1).count() == 7
    assert order.first_n(ids(spark, 3), "note_id", 7, 1).count() == 3
    assert order.first_n(ids(spark, 3), "note_id", None, 1).count() == 3


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
@settings(max_examples=100, deadline=None)
def test_lcs(a, b):
    assert lcs(a, b) == plain_lcs(a, b)


def test_subsequence_looks_at_shared_tokens_only(monkeypatch):
    """A common beginning is counted, and of what follows only tokens that both sides have are compared."""
    from turnloom.operators import rouge as module

    asked, plain = [], module._lcs
    monkeypatch.setattr(module, "_lcs", lambda a, b: asked.append((a, b)) or plain(a, b))
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 9))] for _ in range(2))
        a, b = (["x"] * 2 + a, ["x"] * 2 + b) if rng.random() < 0.5 else (a, b)
        assert module.lcs(a, b) == plain_lcs(a, b)
    assert all(set(a) == set(b) for a, b in asked)
    asked.clear()
    assert module.lcs(list("abcde"), list("abc")) == 3 and not asked


def test_overlap_scores():
    a, b = tokens("the cat sat down"), tokens("the cat ran away")
    assert ngram_scores(a, b, 1)[2] == pytest.approx(0.5)
    assert ngram_scores(a, a, 2) == (1, 1, 1) and lcs_scores(a, a) == (1, 1, 1)
    assert ngram_scores(a, tokens("x y"), 1)[2] == 0 and lcs_scores(a, []) == (0, 0, 0)
    assert tokens("Running, RUNS!") == ["run", "run"] and tokens(None) == []


def test_rouge_column(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b", "x"), (None, "a")], "r string, g string")
    got = [tuple(x)[0] for x in df.select(rouge(F.col("r"), F.col("g"))).collect()]
    assert [(g.rouge1_f, g.rougeL_f, g.lcs) for g in got] == [(1, 1, 3), (0, 0, 0), (0, 0, 0)]


@pytest.fixture(scope="module")
def train(spark):
    rows = [("note-cardiac", "Patient reports chest pain radiating to the left arm, age 58."), ("note-derm", "Itchy rash on both forearms for two weeks."), ("note-ortho", "Knee swelling after a football injury.")]
    return spark.createDataFrame(rows, "note_id string, text string")


def test_retrieval(spark, train):
    asked = spark.createDataFrame([("q1", "70-year-old with chest pain and arm pain"), ("q2", "zzz qqq"), ("q3", "")], "note_id string, text string")
    got = {r.query_id: r for r in retrieval.Retriever().fit(train).top(asked).collect()}
    assert got["q1"].note_id == "note-cardiac" and got["q1"].similarity > 0
    assert (got["q2"].note_id, got["q2"].similarity) == ("note-cardiac", 0.0)
    assert (got["q3"].note_id, got["q3"].similarity) == ("note-cardiac", 0.0)
    many = retrieval.Retriever().fit(train).top(asked, 5)
    assert many.count() == 9


def test_retrieval_needs_a_fit(train):
    with pytest.raises(RuntimeError):
        retrieval.Retriever().top(train)


def test_retrieval_blocks_and_heavy_terms_agree(spark, train, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    notes = spark.createDataFrame([(f"n{i:03d}", " ".join(rng.choices(words, k=12))) for i in range(60)], "note_id string, text string")
    whole = sorted(tuple(r) for r in retrieval.Retriever().fit(notes).top(notes, 3).collect())
    monkeypatch.setattr(retrieval, "QUERY_CELL", 7)
    monkeypatch.setattr(retrieval, "TRAIN_CELL", 11)
    monkeypatch.setattr(retrieval, "ROWS", 5)
    small = sorted(tuple(r) for r in retrieval.Retriever().fit(notes).top(notes, 3).collect())
    assert whole == small
    firsts = {r.query_id: (r.note_id, r.similarity) for r in retrieval.Retriever().fit(notes).top(notes).collect()}
    assert all(v[1] == pytest.approx(1.0) for v in firsts.values())


def test_queries_with_equal_training_notes_need_no_grid(spark, monkeypatch):
    """Of many queries, those of which a copy is a training note, or a note that is equal to nine decimals, ask no cell."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(words[:200])
    rows = [(f"n{i:02d}", " ".join(rng.choices(words, k=30))) for i in range(30)]
    rows += [("m1", rows[3][1]), ("m0", rows[3][1]), ("z", rows[4][1]), ("b", f"{long} {'often ' * 3000}"), ("a", f"{long} {'often ' * 3001}"), ("e1", ""), ("e0", "zz")]
    notes = spark.createDataFrame(rows, "note_id string, text string")
    asked = notes.union(spark.createDataFrame([("q1", "w1 w2 w3"), ("q2", "w1 w2 w3"), ("q3", "")], notes.schema))
    fitted, grid, sizes = retrieval.Retriever().fit(notes), retrieval._grid, []
    want = {k: sorted(map(tuple, fitted.top(asked, k).collect())) for k in (1, 2)}
    monkeypatch.setattr(retrieval, "QUERY_CELL", 5)
    monkeypatch.setattr(retrieval, "_grid", lambda a, n, *rest: sizes.append(n) or grid(a, n, *rest))
    for k in (1, 2):
        assert sorted(map(tuple, fitted.top(asked, k).collect())) == want[k]
    top = {q: n for q, n, *_ in want[1]}
    assert top["n03"] == top["m1"] == "m0" and top["z"] == "n04" and top["b"] == top["a"] == "a"
    assert sizes[0] == 2 and sizes[1] > 20  # q1 and q2 are one query, texts without known terms another


def test_training_notes_that_ask_are_vectors_once(spark, monkeypatch):
    rng = random.Random(9)
    notes = spark.createDataFrame([(f"n{i:02d}", " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) * 2) for i in range(30)], "note_id string, text string")
    ids_ = notes.where("note_id > 'n09'").select("note_id")
    fitted, made, vectors = retrieval.Retriever().fit(notes.join(ids_, "note_id", "left_semi")), [], retrieval._marked
    monkeypatch.setattr(retrieval, "_marked", lambda rows, size: made.append(1) or vectors(rows, size))
    for cell in (retrieval.QUERY_CELL, 4):
        monkeypatch.setattr(retrieval, "QUERY_CELL", cell)
        for k in (1, 3):
            want = sorted(map(tuple, fitted.top(notes, k).collect()))
            made.clear()
            assert sorted(map(tuple, fitted.top(notes, k, ids_).collect())) == want and len(made) == (cell == 4)


def test_vectors_of_cells_are_shuffled_once(spark, train, monkeypatch):
    """Vectors were copied to every cell of their row or column of the grid, so shuffled bytes grew as the product of both sides."""
    monkeypatch.setattr(retrieval, "QUERY_CELL", 2)
    monkeypatch.setattr(retrieval, "TRAIN_CELL", 1)
    fitted = retrieval.Retriever().fit(train)
    out = retrieval._grid(fitted.train, 3, fitted.train, 3, 2, fitted.held)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and "CoGroup" not in plan
    assert plan.count("Exchange RoundRobinPartitioning") == 2
    got = {(r.query_id, r.note_id): r.similarity for r in retrieval._ranked(out, 1).collect()}
    assert got == {(i, i): 1.0 for i in ("note-cardiac", "note-derm", "note-ortho")}


def test_split_texts_without_a_shuffle(spark, monkeypatch):
    """Texts were joined to the ids of their split, which shuffles them once they are many."""
    rows = spark.createDataFrame([(i, f"text {i % 70}" if i else None) for i in range(100)] + [(5, "text 8"), (200, "")], "doc_id long, text string")
    ids = dataset.split(dataset.deduplicated(rows, "text", "doc_id").select("note_id", "text"))
    want = {s: sorted(map(str, ids.where(F.col("split") == s).select("note_id", "text").collect())) for s in dataset.FRACTIONS}
    for bits in (None, lambda hashes: np.full(1 << continuation.BITS - 3, 255, np.uint8)):
        if bits:
            monkeypatch.setattr(continuation, "_bit_map", bits)
        got = dataset.split_texts(rows, "text", "doc_id")
        assert {s: sorted(map(str, x.collect())) for s, x in got.items()} == want
    assert sum(map(len, want.values())) == 71
    kept = dataset.split_texts(rows, "text", "doc_id")["train"]._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert kept.startswith("Union")


def test_what_is_written_leaves_no_shuffle(spark):
    """Shuffle files of tables that had been written stayed until the driver's memory was collected."""
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    out = io.written(spark.range(1000).repartition(3, "id"), "x")
    for _ in range(50):  # files go beside what runs next
        if files() - before:
            time.sleep(0.1)
    assert not files() - before and out.count() == 1000


def test_counts_of_notes_and_of_occurrences(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choices(["ab", "cd", "ef", "gh"], k=rng.randint(0, 12))) for _ in range(40)]
    tf, df = Counter(), Counter()
    for t in texts:
        w = t.split()
        w += [f"{a} {b}" for a, b in zip(w, w[1:])]
        tf.update(w)
        df.update(set(w))
    got = retrieval.vocabulary(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "note_id string, text string"))
    assert {r.term: (r.tf, r.df) for r in got.collect()} == {t: (n, df[t]) for t, n in tf.items()}


def test_terms_are_added_up_in_partitions_that_grow_in_number(spark, train, monkeypatch):
    """Counts were added up in the tasks that read the texts, whose tables grew with their share of the texts."""
    import re

    want = sorted(map(tuple, retrieval.vocabulary(train, 9).collect()))
    size = sum(len(r.text) for r in train.collect())
    monkeypatch.setattr(retrieval, "TEXT_BYTES", 4)
    out = retrieval.vocabulary(train, 9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = [int(x) for x in re.findall(r"hashpartitioning\(term#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert parts and max(parts) == -(-size // 4)
    assert re.search(r"(?s)Aggregate.*REPARTITION_BY_NUM", plan) and not re.search(r"(?s)REPARTITION_BY_NUM.*Aggregate", plan)
    assert sorted(map(tuple, out.collect())) == want and len(want) == 9


def test_all_pairs_makes_scores_once(spark, monkeypatch):
    """A join of the scores with themselves made every arm twice where its shuffles were not found to be equal."""
    from turnloom.plans import registry

    rows = spark.createDataFrame([("half", "n1", 0.5), ("self", "n1", 1.0), ("successor", "n1", 0.25), ("self", "n2", 1.0), ("half", "n2", None)], "arm string, note_id string, rouge1 double")
    monkeypatch.setattr(registry, "_scores", lambda spark, d: rows)
    out = registry.QUERIES["all_pairs"](spark, "")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {("half", "self", "n1", -0.5), ("half", "successor", "n1", 0.25), ("self", "successor", "n1", 0.75), ("half", "self", "n2", None)}
    assert out.columns == ["arm_a", "arm_b", "note_id", "rouge1_delta"] and set(map(tuple, out.collect())) == want


def scores(spark, values, name="x"):
    return spark.createDataFrame([(f"n{i}", float(v)) for i, v in enumerate(values)], f"note_id string, {name} double")


def test_bootstrap(spark):
    r = stats.bootstrap(scores(spark, [5, 5, 5, 5]), "note_id", ["x"], resamples=50).first()
    assert (r.point_estimate, r.ci_low, r.ci_high, r.n, r.n_resamples) == (5, 5, 5, 4, 50)
    r = stats.bootstrap(scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5]), "note_id", ["x"], resamples=200).first()
    assert r.ci_low <= 0.3 <= r.ci_high and r.point_estimate == pytest.approx(0.3)
    again = stats.bootstrap(scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5]), "note_id", ["x"], resamples=200).first()
    assert r == again
    with pytest.raises(ValueError):
        stats.bootstrap(scores(spark, [1]).limit(0), "note_id", ["x"])


def test_bootstrap_agrees_with_numpy_draws(spark):
    x = np.random.default_rng(1).normal(size=300)
    r = stats.bootstrap(scores(spark, x), "note_id", ["x"]).first()
    mean, low, high = stats.bootstrap_like_pcg64(list(x))
    assert r.point_estimate == pytest.approx(mean, abs=1e-6)
    assert r.ci_low == pytest.approx(low, abs=0.02) and r.ci_high == pytest.approx(high, abs=0.02)


def test_draws_of_each_resample_add_up(spark):
    n = 3 * stats.BLOCK + 5
    rows = stats.block_counts(spark, n, 40, 7).collect()
    assert {sum(r.c for r in rows if r.b == b) for b in range(40)} == {n}
    shares = np.array([sum(r.c for r in rows if r.block == k) for k in range(4)]) / n / 40
    assert shares == pytest.approx(np.array([stats.BLOCK] * 3 + [5]) / n, abs=0.01)
    # Within a block every record is as likely as another, and counts of a record spread as a binomial's do.
    c = np.full(400, stats.BLOCK)
    times = stats._sums(2, np.eye(stats.BLOCK)[:, :50], np.arange(400), c, 7)[:, :50]
    assert times.mean() == pytest.approx(1, abs=0.03) and times.var() == pytest.approx(1, abs=0.05)


def test_bootstrap_of_50000_records_agrees_with_numpy(spark):
    x = np.random.default_rng(2).gamma(2.0, 3.0, 50_000)
    r = stats.bootstrap(scores(spark, x), "note_id", ["x"]).first()
    mean, low, high = stats.bootstrap_like_pcg64(list(x))
    width = high - low
    assert r.point_estimate == pytest.approx(mean, abs=1e-6)
    assert r.ci_low == pytest.approx(low, abs=0.1 * width) and r.ci_high == pytest.approx(high, abs=0.1 * width)


def test_bootstrap_of_many_records_counts_all_and_skips_nulls(spark):
    n = 3 * stats.BLOCK + 5
    rows = spark.range(n).selectExpr("cast(id as string) as note_id", "case when id % 5 < 4 then cast(id % 100 as double) end as x", "cast(null as double) as y")
    r = {x.metric: x for x in stats.bootstrap(rows, "note_id", ["x", "y"], resamples=300).collect()}
    x = np.array([i % 100 for i in range(n) if i % 5 < 4], float)
    assert r["x"].n == n and r["x"].point_estimate == pytest.approx(x.mean(), abs=1e-6) and r["y"].point_estimate is None
    deviation = x.std() / len(x) ** 0.5
    assert r["x"].ci_high - r["x"].ci_low == pytest.approx(2 * 1.96 * deviation, rel=0.2)
    assert r["x"].ci_low < x.mean() < r["x"].ci_high


def test_paired_delta(spark):
    a = scores(spark, [0.1, 0.5, 0.9])
    same = stats.paired_deltas(a, a, "note_id", ["x"], resamples=50).first()
    assert (same.delta, same.ci_low, same.ci_high, same.excludes_zero) == (0, 0, 0, False)
    more = stats.paired_deltas(a.withColumn("x", F.col("x") + 0.1), a, "note_id", ["x"], resamples=50).first()
    assert more.delta == pytest.approx(0.1, abs=1e-6) and more.ci_low == pytest.approx(0.1, abs=1e-6) and more.excludes_zero
    with pytest.raises(ValueError):
        stats.paired_deltas(a, scores(spark, [1]), "note_id", ["x"])


def arm_rows(spark, per_arm):
    rows = [(a, f"n{i}", float(v)) for a, xs in per_arm.items() for i, v in xs]
    return spark.createDataFrame(rows, "arm string, note_id string, rouge1 double")


def test_compare(spark):
    base = list(enumerate([0.2, 0.4, 0.6]))
    rows = arm_rows(spark, {"a": [(i, v + 0.1) for i, v in base], "b": base, "c": base})
    got = {(r.arm_a, r.arm_b): r for r in compare.compare(rows, ["a", "b", "c"], ["rouge1", "bertscore_f1"], resamples=40).collect()}
    assert got["a", "b"].delta == pytest.approx(0.1, abs=1e-6) and got["a", "b"].excludes_zero
    assert got["b", "c"].delta == 0 and not got["b", "c"].excludes_zero and len(got) == 3


@pytest.mark.parametrize("other", [[(0, 0.1), (1, 0.1), (9, 0.1)], [(0, 0.1), (1, 0.1)]])
def test_compare_refuses_other_records(spark, other):
    rows = arm_rows(spark, {"a": [(0, 0.1), (1, 0.1), (2, 0.1)], "b": other})
    with pytest.raises(ValueError, match="differ"):
        compare.compare(rows, ["a", "b"], ["rouge1"])


def test_stochastic_arms_are_named(spark):
    rows = spark.createDataFrame([("a", (True,)), ("b", (False,))], "arm string, decoding struct<do_sample: boolean>")
    assert compare.stochastic(rows) == ["a"]


def test_arms_end_to_end(spark):
    said = [f"Doctor: question {i}?\nPatient: answer {i}.\nDoctor: more {i}\nPatient: fine" for i in range(8)]
    rows = spark.createDataFrame([(f"n{i}", f"note {i} with pain {i * 7}", t) for i, t in enumerate(said)], "note_id string, clinical_note string, conversation string")
    out = arms.run(rows).cache()
    assert out.count() == 32
    own = {r.note_id: r for r in out.where("arm = 'self'").collect()}
    assert all(r.rouge1 == 1 and r.rougeL == 1 for r in own.values())
    table = arms.aggregate(out, sorted(arms.ARMS), resamples=20)
    assert table.count() == 4 * len(arms.METRICS)
    text = compare.markdown(table, arms.valid_rate(out), compare.compare(out, sorted(arms.ARMS), resamples=20))
    assert "### half − retrieval" in text and "| self | 1.000 [1.000, 1.000]" in text
    for tokens, found in ((None, None), ("num_turns", float(out.agg({"num_turns": "sum"}).first()[0]))):
        speed = arms.Speed(out, tokens)
        speed.made.write.format("noop").mode("overwrite").save()
        seen = speed.result()
        assert seen["n_records"] == 32 and (seen["tokens_per_second"] and seen["tokens_per_second"] * seen["wall_clock_s"]) == (found and pytest.approx(found))


def test_contamination(spark):
    said = ["\n".join(f"{'Doctor' if k % 2 == 0 else 'Patient'}: word{i} other{i}" for k in range(6)) for i in range(12)] + ["Doctor: short"]
    rows = spark.createDataFrame([(f"n{i:02d}", t) for i, t in enumerate(said)], "note_id string, conversation string")
    probe = contamination.probe(rows, n=None)
    assert probe.count() == 12
    deltas = contamination.delta(probe, resamples=50)
    v = contamination.verdict(deltas).first()
    assert v.verdict == "substantial" and v.delta > 0.3
    none = contamination.probe(rows, lambda x: F.lit("zzz"), n=None)
    v = contamination.verdict(contamination.delta(none, resamples=20)).first()
    assert v.verdict == "not detected" and v.relative_lift is None
    assert "not detected" in contamination.report(contamination.delta(none, resamples=20), contamination.verdict(contamination.delta(none, resamples=20)))


def test_embed_score(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", [3.0, 0.0])], "id string, vec array<double>")
    got = embedscore.embed_score(vecs, vecs, spark.createDataFrame([("a", "b"), ("a", "a")], "gen_id string, ref_id string"))
    rows = {(r.gen_id, r.ref_id): (r.p, r.r, r.f1) for r in got.collect()}
    assert rows["a", "b"] == (0.5, 1.0, pytest.approx(2 / 3, abs=1e-6)) and rows["a", "a"] == (1, 1, 1)


def test_embed_score_in_parts(spark):
    """Texts cut into small parts, with a vector that most rows repeat, score as whole ones."""
    rng = np.random.default_rng(6)
    texts = {k: np.concatenate([rng.normal(size=(n, 3)).round(1), np.tile([1.0, 0.0, 0.5], (n, 1))]) for k, n in (("a", 40), ("b", 7), ("c", 1))}
    vecs = spark.createDataFrame([(k, v.tolist()) for k, m in texts.items() for v in m], "id string, vec array<double>")
    pairs = [(x, y) for x in "abc" for y in "abc"] + [("a", "none")]
    got = {(r.gen_id, r.ref_id): (r.p, r.r, r.f1) for r in embedscore.embed_score(vecs, vecs, spark.createDataFrame(pairs, "gen_id string, ref_id string"), 5).collect()}
    assert got == {(x, y): pytest.approx(embedscore.match(texts[x], texts[y]), abs=1e-6) for x, y in pairs if y != "none"}


def test_bertscore_against_a_plain_form(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 30)))
    pairs = [(text(), text()) for _ in range(20)] + [(None, "a"), ("a", None), ("", ""), ("a b", "b a"), ("w " * 1500, "w v " * 700)]
    got = spark.createDataFrame(pairs, "r string, g string").select(embedscore.bertscore(F.col("r"), F.col("g")).alias("s")).select("s.*").collect()
    for (r, g), row in zip(pairs, got):
        a, b = embedscore.hashed(g or ""), embedscore.hashed(r or "")
        cos = [[float(x @ y) / float(np.linalg.norm(x) * np.linalg.norm(y)) for y in b[:200]] for x in a[:200]]
        if len(a) <= 200 and len(b) <= 200:
            p, q = (sum(map(max, cos)) / len(a), sum(map(max, zip(*cos))) / len(b)) if len(a) and len(b) else (0.0, 0.0)
            assert (row.p, row.r) == (pytest.approx(p), pytest.approx(q)) and row.f1 == pytest.approx(2 * p * q / (p + q) if p + q else 0)
        else:
            assert row.r == pytest.approx(1.0) and row.p == pytest.approx((1 + cos[1][0]) / 2)


def test_words_are_matched_once():
    """Words that are encoded once each give what whole texts give, also where a word has no length."""
    rng = random.Random(7)
    encoded = []
    plain = lambda words: np.array([np.zeros(3) if w == "none" else np.random.default_rng(len(w) * 999 + ord(w[0])).normal(size=3) for w in words]).reshape(-1, 3)
    vectors = lambda words: encoded.extend(words) or plain(words)

    some = ["none", *("abcdefgh"[i] * n for i in range(8) for n in (1, 2))]
    for _ in range(60):
        r = [rng.choice(some) for _ in range(rng.randint(0, 40))]
        known = embedscore.Reference(r, vectors)
        for g in (r, r[: len(r) // 2], ["none"], [], [rng.choice(some) for _ in range(rng.randint(0, 30))]):
            encoded.clear()
            assert known.match(g) == pytest.approx(embedscore.match(plain(g), plain(r)), abs=1e-12)
            assert len(encoded) == len(set(g) - set(r)) * bool(r)


def test_arms_are_scored_in_one_stage(spark):
    """A note goes to one join for all of its arms, without its text, and rows of all arms are scored together."""
    told = spark.createDataFrame([(str(i), f"had {i} pills", f"Doctor: {i}\nPatient: a {i}\nDoctor: b\nPatient: c") for i in range(8)], "note_id string, clinical_note string, conversation string")
    arms_ = {"self": arms.echo, "half": arms.first_half, "successor": arms.successor}
    out = arms.run(told, arms_, encode=embedscore.hashed)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r.arm, r.note_id): r for r in out.collect()}
    assert len(got) == 24
    for name, generate in arms_.items():
        for r in arms.scored(told.join(generate(told), "note_id"), encode=embedscore.hashed).collect():
            assert got[name, r.note_id].asDict() == {"arm": name, **r.asDict()}


def test_cells_multiply_out_few_pairs(monkeypatch):
    """A cell gives what a whole product gives, and multiplies out only pairs that may beat a query's best."""
    rng = np.random.default_rng(8)
    size, n, k = 3000, 600, 3
    chance = 1 / np.arange(1, size + 1)
    sets = [np.unique(rng.choice(size, rng.integers(0, 60), p=chance / chance.sum())) for _ in range(2 * n)]
    sets[n] = sets[5] = np.zeros(0, int)
    raw = [rng.random(len(s)) + 0.5 for s in sets]
    unit = [w / np.sqrt((w * w).sum()) if len(w) else w for w in raw]
    table = lambda i: pa.table([[f"n{x:04d}" for x in i], pa.array([sets[x].tolist() for x in i], pa.list_(pa.int32())), pa.array([unit[x].tolist() for x in i], pa.list_(pa.float64()))], ["note_id", "i", "w"])
    dense = np.zeros((2 * n, size))
    for x, (s, w) in enumerate(zip(sets, unit)):
        dense[x, s] = w
    asked, held = list(range(n)), rng.permutation(np.arange(n, 2 * n)).tolist()
    sims = np.round(dense[:n] @ dense[n:].T, retrieval.DECIMALS)
    multiplied, frequent = [], retrieval._Asked.frequent
    monkeypatch.setattr(retrieval._Asked, "frequent", lambda self, q, r, block: multiplied.append(len(q)) or frequent(self, q, r, block))
    for most in (retrieval.AT_ONCE, 50):
        monkeypatch.setattr(retrieval, "AT_ONCE", most)
        got = retrieval._best(table(asked), table(held), k, size).to_pylist()
        want = [(f"n{q:04d}", f"n{n + r:04d}", sims[q, r]) for q in range(n) for r in np.argsort(-sims[q], kind="stable")[:k]]
        assert [(r["query_id"], r["note_id"]) for r in got] == [w[:2] for w in want]
        assert np.allclose([r["similarity"] for r in got], [w[2] for w in want], atol=1e-8)
    assert sum(multiplied) < n * n


def test_every_query_bounds_its_batches(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        registry.QUERIES["text_lengths"](spark, sf_dir)
        assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)
