"""Language models in arms: a worker loads a model once and keeps it for all tasks that ask for the same one.

What loads is named, MODULE:FUNCTION, and imported in the worker, so neither weights nor a library for them go through
the driver.  It is called as load(name, adapter=..., max_seq_len=..., load_in_4bit=..., seed=..., chat_template=...) and returns an
object with generate(messages, max_new_tokens=..., do_sample=..., temperature=...) -> (text, tokens generated).
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Any

import pyarrow as pa
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame

from turnloom.functions.text import PROMPT_PREFIX, SYSTEM_PROMPT

MAX_NEW_TOKENS, TEMPERATURE = 512, 0.7
GENERATED = "note_id string, generated string, gen_tokens long"


@dataclass(frozen=True)
class Spec:
    """A model by what it is loaded from.  With an adapter the adapter is loaded, which names its base itself."""

    loader: str
    base: str
    adapter: str | None = None
    max_seq_len: int = 4096
    load_in_4bit: bool = True
    seed: int = 42
    chat_template: str = "qwen-2.5"

    @property
    def name(self) -> str:
        return self.adapter or self.base


_held: dict[Spec, Any] = {}
_holder = 0


def named(spec: str) -> Callable:
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def held(spec: Spec) -> Any:
    """The model of spec in this process, loaded if no task before has asked for it; one model at a time is kept.  A
    process that was forked from one that holds a model loads its own."""
    global _holder
    if _holder != os.getpid():
        _held.clear()
        _holder = os.getpid()
    if spec not in _held:
        _held.clear()
        options = {k: v for k, v in asdict(spec).items() if k not in ("loader", "base")}
        _held[spec] = named(spec.loader)(spec.name, **options)
    return _held[spec]


def messages(note: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": PROMPT_PREFIX + note}]


def accelerated(gpus: int = 1, cores: int = 1, memory: str = "16g") -> ResourceProfile:
    """Executors with accelerators for the stage that generates, one for each task; the other stages go without."""
    executor = ExecutorResourceRequests().cores(cores * gpus).memory(memory).resource("gpu", gpus)
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(cores).resource("gpu", 1)).build


def generator(spec: Spec, max_new_tokens: int = MAX_NEW_TOKENS, do_sample: bool = False, temperature: float = TEMPERATURE, profile: ResourceProfile | None = None) -> Callable[[DataFrame], DataFrame]:
    """note_id, generated and gen_tokens of rows of (note_id, clinical_note).  Decoding is greedy unless do_sample; the
    temperature is told to a model that samples only.  A null note is an empty one."""
    options: dict[str, Any] = {"max_new_tokens": max_new_tokens, "do_sample": do_sample} | ({"temperature": temperature} if do_sample else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                said = [held(spec).generate(messages(note or ""), **options) for note in b["clinical_note"].to_pylist()]
                texts, counts = zip(*said)
                yield pa.RecordBatch.from_arrays([b["note_id"], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["note_id", "generated", "gen_tokens"])

    return lambda pairs: pairs.select("note_id", "clinical_note").mapInArrow(run, GENERATED, profile=profile)
