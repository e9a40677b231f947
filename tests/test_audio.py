from __future__ import annotations

import io as bytes_io
import struct
import wave

import numpy as np
import pytest

from turnloom import cli
from turnloom.sources import audio, io


def tone(hz, seconds, rate, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def test_samples_survive_a_round_trip():
    x = np.random.default_rng(1).integers(-(2**15), 2**15, (500, 2)).astype("<i2")
    out = bytes_io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(44_100)
        w.writeframes(x.tobytes())
    rate, got = audio.decode(out.getvalue())
    assert rate == 44_100 and (got * 2**15 == x).all()
    assert audio.encode(got, rate) == out.getvalue()


@pytest.mark.parametrize("kind, bits, values", [(1, 8, bytes([0, 128, 255])), (1, 24, b"\x00\x00\x80\x00\x00\x00\xff\xff\x7f"), (1, 32, struct.pack("<3i", -(2**31), 0, 2**31 - 1)), (3, 32, struct.pack("<3f", -1, 0, 1)), (3, 64, struct.pack("<3d", -1, 0, 1))])
@pytest.mark.parametrize("extensible", [False, True])
def test_kinds_of_samples(kind, bits, values, extensible):
    fmt = struct.pack("<HHIIHH", audio.EXTENSIBLE if extensible else kind, 1, 8000, 1000 * bits, bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 4, kind) + bytes(14)
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"  # a chunk of odd length is padded
    data = b"RIFF" + bytes(4) + b"WAVE" + odd + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(values)) + values
    rate, x = audio.decode(data)
    assert rate == 8000 and x.ravel() == pytest.approx([-1, 0, 1], abs=0.01)


def test_what_is_no_recording():
    whole = audio.encode(np.zeros(10))
    for bad in (b"", b"ID3 something", whole[:12], whole.replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 7, 1), 1), whole.replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 1, 0), 1)):
        with pytest.raises(ValueError):
            audio.decode(bad)
    assert audio.decode(audio.encode(np.zeros(0)))[1].shape == (0, 1)


@pytest.mark.parametrize("rate", [8000, 22_050, 44_100, 48_000])
def test_resampling_keeps_tones_and_drops_what_is_too_high(rate):
    x = audio.resample(tone(440, 1, rate), rate)
    assert len(x) == audio.RATE and x[1000:-1000] == pytest.approx(tone(440, 1, audio.RATE)[1000:-1000], abs=2e-3)
    if rate > 2 * audio.RATE:
        assert np.abs(audio.resample(tone(10_000, 1, rate), rate)[1000:-1000]).max() < 1e-3
    assert audio.resample(x, audio.RATE) is x


def speaking(rate=16_000):
    noise = np.random.default_rng(3).normal(0, 1e-3, 6 * rate)
    for start, seconds in ((0.6, 1.0), (1.75, 0.5), (3.0, 0.1), (4.2, 0.9)):
        s = int(start * rate)
        noise[s : s + int(seconds * rate)] += tone(300, seconds, rate)
    return noise


def test_stretches_of_speech():
    """A short pause is part of a stretch, a long one parts two, a click is no speech."""
    found = [(s / audio.RATE, e / audio.RATE) for s, e in audio.speech(speaking())]
    assert found == [pytest.approx((0.6 - 0.09, 2.25 + 0.09), abs=0.07), pytest.approx((4.2 - 0.09, 5.1 + 0.09), abs=0.07)]
    assert audio.speech(np.zeros(16_000)) == audio.speech(np.zeros(0)) == []


def _heard(x):
    return f"{len(x) / audio.RATE:.0f}s"


def test_recordings(spark, tmp_path, capsys):
    stereo = np.stack([speaking(48_000), speaking(48_000)], axis=1)
    (tmp_path / "a.wav").write_bytes(audio.encode(stereo, 48_000))
    (tmp_path / "b.wav").write_bytes(audio.encode(np.zeros(1000)))
    found = audio.stretches(io.read_audio(spark, str(tmp_path / "*.wav"))).orderBy("place").collect()
    assert [(r.path.rsplit("/")[-1], r.place) for r in found] == [("a.wav", 0), ("a.wav", 1)]
    for r in found:
        rate, x = audio.decode(bytes(r.wav))
        assert rate == audio.RATE and len(x) / rate == pytest.approx(r.end_s - r.start_s)
    assert cli.main(["transcribe", str(tmp_path / "a.wav"), str(tmp_path / "b.wav"), "--transcriber", "tests.test_audio:_heard", "--out", str(tmp_path / "o")], spark) == 0
    assert "a.wav: 2s 1s" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "o")).count() == 2
