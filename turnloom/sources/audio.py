"""Recordings as tables: RIFF/PCM decoding, one channel at one rate, stretches of speech by their energy, and wav again.

Whole files come from Spark's reader; decoding runs where they are, a file at a time.  Speech to text is a hook over the
stretches (a function from a waveform to a text), so a long recording is transcribed in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a second that transcribers take.
RATE = 16_000
# How a wav file names its samples.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the resampling filter to either side, and how steep it falls (a Kaiser window's beta).
CROSSINGS, STEEPNESS = 16, 8.0
#: Samples that are resampled at once.
BLOCK = 1 << 16
#: Seconds of a frame, of the shortest speech, of the shortest pause that parts it, and of what is kept around it.
FRAME, SPEECH, PAUSE, MARGIN = 0.03, 0.25, 0.3, 0.09
#: Speech is so many decibels over the quietest tenth of the frames, and never under the least level.
OVER_NOISE, LEAST_LEVEL = 10.0, -50.0


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples by channels from -1 to 1) of the bytes of a wav file; anything else raises."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    parts: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        parts.setdefault(name, body)
    if b"fmt " not in parts or b"data" not in parts or len(parts[b"fmt "]) < 16:
        raise ValueError("a wav file needs a format and data")
    kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    if kind == EXTENSIBLE and len(parts[b"fmt "]) >= 26:
        kind = struct.unpack_from("<H", parts[b"fmt "], 24)[0]
    if not channels or not rate or block != channels * (bits // 8):
        raise ValueError("the format of a wav file contradicts itself")
    body = parts[b"data"][: len(parts[b"data"]) // block * block]
    if kind == FLOAT and bits in (32, 64):
        x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
    elif kind == PCM and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif kind == PCM and bits in (16, 32):
        x = np.frombuffer(body, f"<i{bits // 8}").astype(np.float64) / 2 ** (bits - 1)
    elif kind == PCM and bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        x = (wide.view("<i4").ravel() >> 8).astype(np.float64) / 2**23
    else:
        raise ValueError(f"samples of kind {kind} with {bits} bits are not read")
    return rate, x.reshape(-1, channels)


def encode(samples: np.ndarray, rate: int = RATE) -> bytes:
    """The bytes of a wav file of 16-bit samples; samples (by channels, or of one) from -1 to 1, others are cut off."""
    x = samples if samples.ndim == 2 else samples[:, None]
    body = np.clip(np.rint(x * 2**15), -(2**15), 2**15 - 1).astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", PCM, x.shape[1], rate, rate * x.shape[1] * 2, x.shape[1] * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


@lru_cache(8)
def _filter(up: int, down: int) -> np.ndarray:
    """A low pass at half the lower rate, in phases (up) by taps: a sine over its argument under a Kaiser window."""
    slow = max(up, down)
    half = CROSSINGS * slow
    taps = -(-(2 * half + 1) // up)
    t = np.arange(taps * up) - half
    h = np.sinc(t / slow) * np.i0(STEEPNESS * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(STEEPNESS)
    h = h.reshape(taps, up).T
    return h / h.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate; at the same one the samples themselves."""
    if rate == to or not len(x):
        return x
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    h = _filter(up, down)
    taps = h.shape[1]
    delay = CROSSINGS * max(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps), x, np.zeros(taps + delay // up + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n)
    for s in range(0, n, BLOCK):
        at = np.arange(s, min(n, s + BLOCK)) * down + delay
        # Output k lies at input (k * down) / up; the filter reaches back from there by its delay.
        first = at // up - taps + 1 + taps
        out[s : s + BLOCK] = np.einsum("kt,kt->k", windows[first], h[at % up][:, ::-1])
    return out


def mono(data: bytes, to: int = RATE) -> np.ndarray:
    """One channel, the mean of all, of a wav file at rate `to`."""
    rate, x = decode(data)
    return resample(x.mean(axis=1) if len(x) else np.zeros(0), rate, to)


def speech(x: np.ndarray, rate: int = RATE) -> list[tuple[int, int]]:
    """(start, end) in samples of the stretches that are loud enough and long enough, pauses that part them left out."""
    size = int(FRAME * rate)
    n = -(-len(x) // size)
    if not n:
        return []
    frames = np.concatenate([x, np.zeros(n * size - len(x))]).reshape(n, size)
    level = 10 * np.log10(np.maximum((frames**2).mean(axis=1), 1e-12))
    floor = np.percentile(level, 10)
    loud = level > max(LEAST_LEVEL, min(floor + OVER_NOISE, level.max() - OVER_NOISE))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]])))
    spans: list[list[int]] = []
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if spans and (s - spans[-1][1]) * FRAME < PAUSE:
            spans[-1][1] = e
        else:
            spans.append([s, e])
    more = int(round(MARGIN / FRAME))
    return [(max(0, s - more) * size, min(len(x), (e + more) * size)) for s, e in spans if (e - s) * FRAME >= SPEECH]


_STRETCHES = "path string, place long, start_s double, end_s double, wav binary"


def stretches(recordings: DataFrame, rate: int = RATE) -> DataFrame:
    """path, place (from 0), start_s, end_s and wav (one channel, 16 bits, at `rate`) of the stretches of speech in
    recordings(path, content); a recording without speech has none, one that is no wav file raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                x = mono(content.as_buffer().to_pybytes(), rate)
                for k, (s, e) in enumerate(speech(x, rate)):
                    yield pa.RecordBatch.from_pylist([{"path": path, "place": k, "start_s": s / rate, "end_s": e / rate, "wav": encode(x[s:e], rate)}])

    return recordings.select("path", "content").mapInArrow(run, _STRETCHES)


def transcribed(found: DataFrame, transcribe: Callable[[np.ndarray], str]) -> DataFrame:
    """path and text of each recording with speech: `transcribe`, from a waveform at RATE to a text, over the rows of stretches(),
    which are dealt to tasks one by one; their texts in order, with blanks between."""

    @F.pandas_udf("string")
    def said(wavs: pd.Series) -> pd.Series:
        return wavs.map(lambda w: transcribe(mono(w).astype(np.float32)).strip())

    rows = found.repartition("path", "place").select("path", "place", said("wav").alias("text")).where("text <> ''")
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))  # a recording's
    return rows.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
