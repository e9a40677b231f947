from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from turnloom.sources import io
from turnloom.streaming import screen


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "quoted", note', "Doctor: x\nPatient: y"), ("é", "z")]
    io.write_pairs_csv(spark.createDataFrame(rows, io.RAW), str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_pairs_csv(spark, str(tmp_path / "c")).collect())) == sorted(rows)


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "x.csv").write_text("data,wrong_column\na,b\n")
    with pytest.raises(ValueError):
        io.read_pairs_csv(spark, str(tmp_path / "x.csv"))
    (tmp_path / "y.csv").write_text("conversation,data\nb,a\n")
    assert tuple(io.read_pairs_csv(spark, str(tmp_path / "y.csv")).first()) == ("a", "b")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_pairs_csv(spark, str(tmp_path / "none.csv"))


def test_splits_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([(f"note-{i}", "train" if i else "test") for i in range(4)], "note_id string, split string")
    io.write_splits(df, str(tmp_path / "s"))
    train = io.read_split(spark, str(tmp_path / "s"), "train")
    assert train.count() == 3
    assert io.note_at(train, 1).first().note_id == "note-2" and io.note_at(train, "note-3").count() == 1
    for bad in (9, -1, "note-0"):
        with pytest.raises(LookupError):
            io.note_at(train, bad)


def test_arms_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("a", "n1", 0.5), ("a", "n2", 0.25), ("b", "n1", 1.0)], "arm string, note_id string, rouge1 double")
    io.write_arms(scores, str(tmp_path / "out"), {"decoding": F.struct(F.lit(False).alias("do_sample"))})
    got = io.read_arms(spark, str(tmp_path / "out/*/*.txt"))
    assert sorted((r.arm, r.note_id, r.rouge1) for r in got.collect()) == [("a", "n1", 0.5), ("a", "n2", 0.25), ("b", "n1", 1.0)]
    assert io.read_arms(spark, str(tmp_path / "out/*/*.txt"), ["b", "unknown"]).count() == 1
    with pytest.raises(FileNotFoundError):
        io.read_arms(spark, str(tmp_path / "out/*/*.txt"), ["unknown"])


def test_arm_is_named_by_its_folder(spark, tmp_path):
    os.makedirs(tmp_path / "zeta")
    io.write_json({"records": [{"note_id": "n", "rouge1": 1.0}]}, str(tmp_path / "zeta/results.json"))
    assert io.read_arms(spark, str(tmp_path / "*/results.json")).first().arm == "zeta"


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    assert io.read_texts(spark, str(tmp_path / "a.txt")).first().text == "café  end"


def test_stream_screen(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a.md", "mail me@example.org"), ("b.md", "fine"), ("data/x", "fine")], "path string, text string").write.parquet(str(src))
    stream = spark.readStream.schema("path string, text string").parquet(str(src))
    screen.screen(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.path, r.reasons) for r in got.collect()) == [("a.md", ["email"]), ("data/x", ["folder"])]
