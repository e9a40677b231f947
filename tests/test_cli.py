from __future__ import annotations

import json

import pyarrow as pa
import pytest

from turnloom import cli
from turnloom.sources import io


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    rows = [(f"Note {i} of pain {i}", f"lead\nDoctor: question {i}\nPatient: answer {i}\nDoctor: more {i}\nPatient: fine {i}") for i in range(40)]
    io.write_pairs_csv(spark.createDataFrame(rows + rows[:2], io.RAW), str(top / "csv"))
    assert cli.main(["build-dataset", str(top / "csv"), "--out", str(top / "data"), "--report", str(top / "r.md")], spark) == 0
    return top


def test_dataset_and_report(spark, built):
    sizes = {r[0]: r[1] for r in spark.read.parquet(str(built / "data")).groupBy("split").count().collect()}
    assert sizes == {"train": 32, "val": 4, "test": 4}
    text = (built / "r.md").read_text()
    assert "exact copies dropped: 2; kept: 40 (95.24%)" in text and "Preambles stripped: 40 (100.00%)" in text and "| num_turns | 4.0 | 4 | 4 |" in text


def test_arms_and_comparison(spark, built, capsys):
    for arm in ("half", "retrieval", "self"):
        assert cli.main(["run-arm", arm, "--data", str(built / "data"), "--out", str(built / "out")], spark) == 0
    assert cli.main(["compare", "--out", str(built / "out")], spark) == 0
    said = capsys.readouterr().out
    assert "### half − retrieval" in said and "100.0%" in said
    found = json.loads((built / "out" / "comparison.json").read_text())
    assert found["arms"] == ["half", "retrieval", "self"] and {r["turn_format_valid_rate"] for r in found["turn_format"]} == {1.0}
    one = json.loads((built / "out" / "self" / "summary.json").read_text())
    assert one["n_records"] == 4 and one["seed"] == 42 and one["throughput"]["records_per_second"] > 0
    means = {r["metric"]: r["point_estimate"] for r in one["aggregate"]}
    assert means["rouge1"] == means["bertscore_f1"] == 1.0 and one["encoder"] == "hashed"
    assert "bertscore_f1" in {r["metric"] for r in found["deltas"]}


def _upper(batches):
    """A stand-in for a language model."""
    for b in batches:
        said = ["Doctor: " + x.upper() + "\nPatient: yes" for x in b["clinical_note"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["note_id"], pa.array(said), pa.array([3] * len(said), pa.int64())], ["note_id", "generated", "gen_tokens"])


def test_model_arm(spark, built):
    args = ["run-arm", "model", "--data", str(built / "data"), "--out", str(built / "models"), "--encoder", "none", "--name", "upper"]
    assert cli.main([*args, "--generator", "tests.test_cli:_upper", "--sampled"], spark) == 0
    one = json.loads((built / "models" / "upper" / "summary.json").read_text())
    assert one["turn_format_valid_rate"] == 1.0 and one["throughput"]["tokens_per_second"] > one["throughput"]["records_per_second"]
    assert "bertscore_f1" not in {r["metric"] for r in one["aggregate"]}
    assert io.read_arms(spark, str(built / "models" / "*" / "*" / "*.txt")).first().decoding.do_sample
    with pytest.raises(ValueError, match="generator"):
        cli.main(args, spark)
    loaded = [*args[:-1], "loaded", "--loader", "tests.test_cli:load", "--model-name", "base", "--adapter", "ad", "--max-new-tokens", "5"]
    assert cli.main(loaded, spark) == 0
    one = json.loads((built / "models" / "loaded" / "summary.json").read_text())
    assert one["adapter"] == "ad" and one["n_records"] == 4 and one["throughput"]["tokens_per_second"] == pytest.approx(5 * one["throughput"]["records_per_second"])
    assert cli.main(["show", "0", "--data", str(built / "data"), "--arm", "self", "--compare", "model", "half", "--loader", "tests.test_cli:load"], spark) == 0


class _Model:
    def generate(self, messages, max_new_tokens, do_sample):
        return "Doctor: hm\nPatient: hm", max_new_tokens


def load(name, **options):
    return _Model()


def test_tokens_and_packing(spark, built, tmp_path, capsys):
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = str(tokenizers.path("byte_bpe_50k.tiktoken"))
    assert cli.main(["run-arm", "half", "--data", str(built / "data"), "--out", str(tmp_path / "o"), "--tokenizer", ranks, "--encoder", "learned"], spark) == 0
    one = json.loads((tmp_path / "o" / "half" / "summary.json").read_text())
    assert one["throughput"]["tokens_per_second"] > 3 * one["throughput"]["records_per_second"] and "bertscore_f1" in {r["metric"] for r in one["aggregate"]}
    assert cli.main(["pack", "--data", str(built / "data"), "--out", str(tmp_path / "p"), "--tokenizer", ranks, "--max-seq-len", "300"], spark) == 0
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert sum(len(r.starts) for r in rows) == 32 and all(len(r.ids) == r.n_tokens <= 300 for r in rows)
    assert "in" in capsys.readouterr().out


def test_probe_and_show(spark, built, capsys):
    assert cli.main(["contamination", "--data", str(built / "data"), "--split", "train"], spark) == 0
    assert "Verdict" in capsys.readouterr().out
    assert cli.main(["contamination", "--data", str(built / "data"), "--split", "train", "--memory", "train"], spark) == 0
    assert "substantial" in capsys.readouterr().out
    for which in ("0", "random"):
        assert cli.main(["show", which, "--data", str(built / "data"), "--arm", "retrieval"], spark) == 0
        assert "rouge1" in capsys.readouterr().out


def test_config(spark, built, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("n: 5\nseed: 7\nsplit: train\n")
    args = ["contamination", "--data", str(built / "data"), "--config", str(tmp_path / "c.yaml"), "--json", str(tmp_path / "x.json")]
    assert cli.main([*args, "--seed", "9"], spark) == 0
    found = json.loads((tmp_path / "x.json").read_text())
    assert (found["n"], found["seed"], found["split"]) == (5, 9, "train") and found["verdict"] and len(found["metrics"]) == 3
    (tmp_path / "c.yaml").write_text("nothing: 5\n")
    with pytest.raises(ValueError, match="unknown options"):
        cli.main(args, spark)


def test_leak_gate(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "ok.md").write_text("fine")
    (tmp_path / "bad.md").write_text("a@example.org")
    assert cli.main(["check-leak", "ok.md", "gone.md"], spark) == 0
    assert cli.main(["check-leak", "ok.md", "bad.md"], spark) == 1
    assert "bad.md: email" in capsys.readouterr().out
