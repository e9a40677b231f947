"""Models that workers hold."""

from __future__ import annotations

import os
import uuid

import pytest

from turnloom.operators import model


class _Shout:
    def __init__(self, name, told):
        self.name, self.told = name, told

    def generate(self, messages, **options):
        note = messages[-1]["content"].removeprefix("Clinical note:\n")
        return f"Doctor: {self.name} {sorted(options)}\nPatient: {note.upper()}", len(note)


def load(name, **told):
    """Leaves a file for each load in the folder that the template names."""
    folder = told["chat_template"]
    with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
        f.write(name)
    return _Shout(name, told)


def test_a_worker_loads_once(spark, tmp_path):
    spec = model.Spec("tests.test_model:load", "base", chat_template=str(tmp_path))
    pairs = spark.range(64).repartition(16).selectExpr("cast(id as string) as note_id", "concat('note ', id) as clinical_note")
    for _ in range(2):
        got = {r.note_id: (r.generated, r.gen_tokens) for r in model.generator(spec)(pairs).collect()}
    assert got["7"] == ("Doctor: base ['do_sample', 'max_new_tokens']\nPatient: NOTE 7", 6) and len(got) == 64
    loads = os.listdir(tmp_path)
    workers = {x.split("-")[0] for x in loads}
    assert len(loads) == len(workers) < 32  # tasks of both runs


def test_adapter_goes_instead_of_its_base(spark, tmp_path):
    spec = model.Spec("tests.test_model:load", "base", adapter="adapters/a", chat_template=str(tmp_path))
    pairs = spark.createDataFrame([("n", None)], "note_id string, clinical_note string")
    row = model.generator(spec, do_sample=True, temperature=0.5)(pairs).first()
    assert row.generated == "Doctor: adapters/a ['do_sample', 'max_new_tokens', 'temperature']\nPatient: " and row.gen_tokens == 0
    assert {open(tmp_path / x).read() for x in os.listdir(tmp_path)} == {"adapters/a"}


def test_one_model_at_a_time(tmp_path):
    one, other = (model.Spec("tests.test_model:load", b, chat_template=str(tmp_path)) for b in "ab")
    first = model.held(one)
    assert model.held(one) is first and model.held(other).name == "b"
    assert model.held(one) is not first and len(os.listdir(tmp_path)) == 3
    with pytest.raises(ModuleNotFoundError):
        model.held(model.Spec("no.such:load", "a"))


def test_profile(spark):
    found = model.accelerated(2, 4)
    assert found.taskResources["gpu"].amount == 1 and found.taskResources["cpus"].amount == 4 and found.executorResources["gpu"].amount == 2
