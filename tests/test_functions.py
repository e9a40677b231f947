from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnloom.functions import dialogue, leak, numbers, text
from turnloom.functions.porter import stem


def values(spark, texts, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *cols)
    return [tuple(r)[1:] for r in df.orderBy("i").collect()]


def test_preamble_goes(spark):
    t = F.col("t")
    body = dialogue.without_preamble(t)
    lead = "keywords: rain; umbrella\n"
    said = "Doctor: What brings you in today?\nPatient: A sore knee."
    assert values(spark, [lead + said, said], body.alias("b"), dialogue.preamble_chars(t, body).alias("n")) == [(said, len(lead)), (said, 0)]


def test_preamble_without_marker_raises(spark):
    with pytest.raises(Exception, match="no speaker marker"):
        values(spark, ["prose only"], dialogue.without_preamble(F.col("t")).alias("b"))


def test_markers_count_at_line_starts_only(spark):
    t = F.col("t")
    texts = ["pre Doctor: no\n  Doctor: no\nPatient: yes", "Doctor: A.\rPatient: B", "😀é\nDoctor: x"]
    body = dialogue.without_preamble(t)
    assert values(spark, texts, body.alias("b"), dialogue.preamble_chars(t, body).alias("n")) == [("Patient: yes", 28), (texts[1], 0), ("Doctor: x", 3)]


def test_turns(spark):
    texts = ["Doctor: Please sit.\nPatient: Thanks.\nDoctor: Where does it hurt?", " Doctor: a \n\nPatient:\t", "x\nDoctor: a"]
    t = F.col("t")
    got = values(spark, texts, dialogue.turns(t).alias("l"), dialogue.n_turns(t).alias("n"))
    assert got[0] == (["Doctor: Please sit.", "Patient: Thanks.", "Doctor: Where does it hurt?"], 3)
    assert got[1][0] == ["Doctor: a", "Patient:"] or got[1][0][-1] == "Patient:"
    assert got[2] == (["x", "Doctor: a"], 2)


def test_turn_format(spark):
    texts = ["Doctor: Come in.\nPatient: Good day.\nDoctor: Any fever?", "A walk by the sea.", "write it as a talk\nDoctor: Next.\nPatient: Here.", "", None]
    flags = dialogue.turn_format(F.col("t"))
    got = values(spark, texts, *[v.alias(k) for k, v in flags.items()])
    assert got[:4] == [(True, 3, True, True), (False, 0, False, False), (False, 3, True, True), (False, 0, False, False)]
    assert values(spark, texts[:3], dialogue.format_valid(F.col("t")).alias("v")) == [(True,), (False,), (False,)]


def test_halves(spark):
    said = [f"{'Doctor' if i % 2 == 0 else 'Patient'}: {i}" for i in range(8)]
    got = values(spark, ["\n".join(said), "\n".join(said[:3]), "no markers"], dialogue.halves(F.col("t")).alias("h"))
    assert (got[0][0].prefix + "\n" + got[0][0].continuation).split("\n") == said
    assert got[0][0].prefix.count("\n") == 3
    assert got[1] == (None,) and got[2] == (None,)


def test_numbers(spark):
    got = values(spark, ["BP 135/85, temp 37.2, age 64", "dose 5.0 mg 5 mg 05", "1,000", "none", ""], numbers.numbers(F.col("t")).alias("x"))
    assert [set(x[0]) for x in got] == [{135, 85, 37.2, 64}, {5}, {1, 0}, set(), set()]


@pytest.mark.parametrize(
    "note, generated, expected",
    [("50 80 37", "50 80 99", (2 / 3, 2 / 3, 1 / 3, 3, 3)), ("age 64", "none", (0, 1, 0, 1, 0)), ("Age 50. Pulse 80.", "pulse 80", (0.5, 1, 0, 2, 1)), ("", "", (1, 1, 0, 0, 0))],
)
def test_faithfulness(spark, note, generated, expected):
    df = spark.createDataFrame([(note, generated)], "n string, g string")
    row = df.select(*[v.alias(k) for k, v in numbers.faithfulness(numbers.numbers(F.col("n")), numbers.numbers(F.col("g"))).items()]).first()
    assert tuple(row) == pytest.approx(expected)


def test_invented(spark):
    df = spark.createDataFrame([("1 2", "3 2 10 1.5")], "n string, g string")
    assert df.select(numbers.invented(numbers.numbers(F.col("n")), numbers.numbers(F.col("g")))).first()[0] == [1.5, 3, 10]


def test_leak_content(spark):
    bad = {"ssn": "SSN 123-45-6789", "mrn": "MRN: 1234567", "nhs": "943 476 5919", "dob": "DOB: 1/2/1950", "email": "a.b@example.com", "header": "x\ndata,conversation\ny"}
    fine = ["64 years old, BP 135/85, seen on 2015-03-12", "Doctor: Hi.\nPatient: Hi.", "é123-45-6789"]
    got = values(spark, [*bad.values(), *fine], leak.content_reasons(F.col("t")).alias("r"))
    assert [r[0] for r in got] == [[k] for k in bad] + [[], [], []]


def test_leak_paths(spark):
    paths = {"data/train.csv": ["folder", "suffix"], "src/data/x.py": [], "annotation/gold_v1/labels.txt": ["gold"], "docs/golden.md": [], "a/x.PARQUET": ["suffix"], "artifacts/eval/r.json": []}
    assert [r[0] for r in values(spark, list(paths), leak.path_reasons(F.col("t")).alias("r"))] == list(paths.values())
    both = leak.reasons(F.col("t"), F.lit("a@example.org"))
    assert [r[0] for r in values(spark, ["artifacts/eval/r.json", "artifacts/evalx.json"], both.alias("r"))] == [[], ["email"]]


def test_note_id_and_chat(spark):
    t = F.col("t")
    assert values(spark, ["abc"], text.note_id(t).alias("x")) == [("note-ba7816bf8f01cfea",)]
    got = values(spark, ["N"], text.chat_text(text.chat_messages(t, F.lit("Doctor: x"))).alias("x"))[0][0]
    assert got.endswith("<|im_start|>user\nClinical note:\nN<|im_end|>\n<|im_start|>assistant\nDoctor: x<|im_end|>\n")
    assert values(spark, ["a" * 5, "é" * 9], text.shown(t, 8).alias("x")) == [("aaaaa",), ("é" * 8 + "\n[first 8 characters]",)]


@pytest.mark.parametrize(
    "word, expected",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
     ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"),
     ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"),
     ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("adjustment", "adjust"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"),
     ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil")],
)
def test_porter(word, expected):
    assert stem(word) == expected
