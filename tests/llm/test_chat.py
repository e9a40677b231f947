"""Chat formatting: places of turns in the outputs of templates of several kinds, and what is read back."""

from __future__ import annotations

import hashlib
import random

import pytest

from turnloom.llm import chat

TALK = [("system", "be brief"), ("user", "hello"), ("assistant", "</s>[INST] ok [/INST]"), ("user", ""), ("assistant", "bye\n"), ("user", "hello")]


def framed(ms):
    """Opens and closes the whole output."""
    return "<begin>" + "".join(f"[{r}]{t}[/{r}]" for r, t in ms) + "<end>"


def system_last(ms):
    """Puts the system text into the last user turn, so each user turn rewrites the one before."""
    told = "".join(t for r, t in ms if r == "system")
    last = max((i for i, (r, _) in enumerate(ms) if r == "user"), default=-1)
    return "".join(f"[I]{told if i == last else ''}{t}[/I]" if r == "user" else t + "$" for i, (r, t) in enumerate(ms) if r != "system")


def trimming(ms):
    return "".join(f"{r}: {t.strip()}\n" for r, t in ms)


def counting(ms):
    """Looks back at all turns."""
    return "".join(f"{i}/{t}" for i, (_, t) in enumerate(ms))


SCHEMA = "conv_id long, turn long, role string, text string"


def test_escape_is_reversible():
    rng = random.Random(3)
    parts = [*chat.CONTROL, "<", "[", "\\", "|im_start|>", "/s>", "s>", "INST]", "a", "\n", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)


@pytest.mark.parametrize("template", [chat.chatml, framed, trimming])
def test_appending_templates(template):
    found = chat.located(template, TALK)
    out = template(TALK)
    assert "".join(p for p, *_ in found) == out
    assert all(out[start : start + len(p)] == p and r is None for p, start, _, r in found)
    for (_, text), (_, _, place, _) in zip(TALK, found):
        said = out[slice(*place)]
        assert (chat.unescape(said) if template is chat.chatml else said) == (text.strip() if template is trimming else text)


def test_history_that_is_rewritten():
    found, out = chat.located(system_last, TALK), system_last(TALK)
    assert "".join(p for p, *_ in found) == out
    assert [r is not None for *_, r in found] == [False, False, False, True, False, True]
    for (role, text), (_, _, place, _) in zip(TALK, found):
        assert out[slice(*place)] == text, role
    forgetful = lambda ms: "".join(f"<{t}>" for _, t in ms[-2:])
    found = chat.located(forgetful, TALK)
    assert [p is None for _, _, p, _ in found] == [True] * 4 + [False] * 2 and found[2][3] == 1


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _talks(spark):
    rows = [(c, n, r, t) for c in (1, 2, 3) for n, (r, t) in enumerate(TALK[: 2 * c])]
    rows += [(7, 0, None, None), (7, None, "assistant", "first"), (7, 0, "a\nb\\n", "x"), (7, 0, "a\nb\\n", "x"), (None, 1, "user", "no id"), (8, 0, "assistant", "long " * 60_000), (8, 1, "user", "é😀")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("template", [chat.chatml, framed])
def test_windows_find_what_whole_prefixes_find(spark, template):
    rows = _talks(spark)
    whole = _rows(chat.pieces(rows, template, None))
    assert len(whole) == rows.count()
    for reach in (0, 1, 3):
        assert _rows(chat.pieces(rows, template, reach)) == whole


def test_broken_promises_raise(spark):
    with pytest.raises(Exception, match="looks back further"):
        chat.pieces(_talks(spark), counting, 1).collect()
    with pytest.raises(Exception, match="rewrites history"):
        chat.pieces(_talks(spark), system_last, 3).collect()
    assert chat.pieces(_talks(spark), counting, None).count() == _talks(spark).count()


def test_read_back(spark):
    docs = _talks(spark)
    got = {r.conv_id: r for r in chat.read_back(chat.pieces(docs)).collect()}
    by = {}
    for r in docs.collect():
        by.setdefault(r.conv_id, []).append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[c])[1:] == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), len(chat.chatml(turns)))
    clashing = docs.selectExpr("*", "1 as piece", "2 as place", "3 as start", "4 as n_turns")
    assert _rows(chat.read_back(chat.pieces(clashing))) == _rows(chat.read_back(chat.pieces(docs)))
    assert chat.read_back(chat.pieces(docs.limit(0))).count() == 0


def test_reader_takes_pieces_cut_anywhere():
    out, rng = chat.chatml(TALK), random.Random(5)
    masks = [p for (r, _), (_, _, p, _) in zip(TALK, chat.located(chat.chatml, TALK)) if r == "assistant"]
    whole = chat.Reader()
    whole.feed(out, None)
    whole.mask = []
    for _ in range(50):
        reader, at = chat.Reader(), 0
        left = list(masks)
        while at < len(out):
            to = min(len(out), at + rng.randint(1, 9))
            reader.feed(out[at:to], None)
            at = to
        assert reader.row(1)[1:3] == whole.row(1)[1:3]
        assert left == masks
    with pytest.raises(ValueError):
        reader.feed("more", None)
        reader.row(1)


def opened(ms):
    """Repeats the first text in every turn."""
    return "".join(f"{ms[0][1][:3]}>{t}\n" for _, t in ms)


@pytest.mark.parametrize("template", [counting, opened])
@pytest.mark.parametrize("size", [1, 1_200_000])
def test_a_broken_promise_raises_at_any_size(template, size):
    state = chat.Appended(template, 1)
    with pytest.raises(ValueError, match="looks back further"):
        for text in ("first" * size, "b", "c", "d", "e"):
            state.push("user", text)
    assert len(state.held) <= 2 and len(state.witness.held) <= 5
