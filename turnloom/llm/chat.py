"""Chat formatting with a template that is only called, never read.

A template is a function from a list of (role, text) to one string.  Prefixes of a conversation that grow by
a turn are rendered one after another; what two consecutive outputs have in common is settled, what is new
is the turn's span.  Two renderings whose last text is a lone probe character, and then another one, differ
in that character alone, so they tell where in its span the turn's own text stands.  An output that does
not go on from the one before shows a template that rewrites history.

`reach` is how many turns back a template looks at most.  With a reach, prefixes are rendered from that many
turns before the last one on (so a conversation costs its length, not its square, and streams through
a task turn by turn).  Every turn is rendered a second time behind the beginning of the first turn and the last
2 * reach + 1, and a template whose pieces differ raises: the same rule for every turn, however long the
conversation.  Without a reach whole prefixes are rendered and the template may do what it likes.

Rules for odd rows: turns go by number, nulls first, then by role and text, so rows of equal numbers have an
order and repeated rows are turns like others.  A null role or text is empty.  Rows with a null conv_id are one
conversation.  Columns besides conv_id, turn, role and text play no part.  An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import trimmed

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

# Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
START, END = CONTROL[:2]
#: The role whose texts are learned.
LEARNED = "assistant"
#: Turns that chatml() looks back at (none, so one is plenty).
REACH = 1
#: Characters of a conversation's first turn that go on standing before its later ones, for comparison.
OPENING = 64
#: Characters that stand in for a text to find its place.
PROBES = "\ue000", "\ue001"

_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN, _MARKED = re.compile(rf"([<\[])(\\*)({_REST})"), re.compile(rf"([<\[])\\(\\*)({_REST})")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)

PIECES = "conv_id long, place long, role string, piece string, start long, text_start long, text_end long, rewrites long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """text without control strings: each gets a backslash after its first character, and one that has backslashes
    there already gets one more, so unescape() finds every text again."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1\2\3", text)


def chatml(messages: list[Message]) -> str:
    """The production template: each turn between markers, control strings escaped; a role's line breaks too."""
    return "".join([f"{START}{escape(role.replace('\\', '\\\\').replace('\n', '\\n'))}\n{escape(text)}{END}\n" for role, text in messages])


def _role(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(written))


def shared(a: str, b: str) -> int:
    """Characters that a and b begin with in common."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:  # the first `low` are equal, the first `high` are not
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _place(template: Template, messages: list[Message], at: int, out: str) -> tuple[int, int] | None:
    """Where in `out`, the rendering of messages, the text of message `at` stands; None if it is not there."""
    one, other = (template([*messages[:at], (messages[at][0], p), *messages[at + 1 :]]) for p in PROBES)
    if one == other:
        return None
    head = shared(one, other)
    foot = shared(one[:head - 1 if head else None:-1], other[:head - 1 if head else None:-1])
    end = len(out) - foot
    return (head, end) if head <= end and out.startswith(one[:head]) and out.endswith(one[len(one) - foot :]) else None


class Appended:
    """Turns taken one by one.  Positions count characters of the whole output.  A turn's piece is known when the next
    one has come, for only then is it seen what of its output stays: push() returns the piece before, last() the last."""

    def __init__(self, template: Template, reach: int | None = None, opening: int | None = None):
        self.template, self.reach, self.opening = template, reach, opening or 0
        self.held: list[Message] = []
        self.out, self.shift, self.start = template([]), 0, 0
        self.turns = 0
        # Who looks back at no more than `reach` turns writes the same whatever stands before them.
        self.witness = Appended(template, 2 * reach + 1, 1) if reach is not None and opening is None else None

    def push(self, role: str, text: str) -> tuple[str | None, int, tuple[int, int] | None, int | None]:
        """(the piece of the turn before, start of this one, place of its text, position from which history is rewritten or None)."""
        old, length = self.out[self.start - self.shift :], self.shift + len(self.out)
        if self.reach is not None and len(self.held) > self.opening + self.reach:
            self.held = [(r, x[:OPENING]) for r, x in self.held[: self.opening]] + self.held[len(self.held) - self.reach :]
            self.out = self.template(self.held)
        before, shift = self.out, length - len(self.out)
        self.held.append((role, text))
        after = self.template(self.held)
        settled = shared(before, after)
        closing = before[settled:]
        rewrites = shift + settled if closing and not after.endswith(closing) else None
        if self.reach is not None and rewrites is not None:
            raise ValueError(f"the template rewrites history {len(closing)} characters back; ask without a reach")
        piece = old[: len(old) - len(closing)] if self.turns else None
        if self.turns:
            self.start = shift + settled
        self.out, self.shift, self.turns = after, shift, self.turns + 1
        if self.opening:
            return piece, self.start, None, rewrites
        if self.witness and ((piece, self.start) != self.witness.push(role, text)[:2] or self.last() != self.witness.last()):
            raise ValueError(f"the template looks back further than {self.reach} turns")
        place = _place(self.template, self.held, len(self.held) - 1, after)
        return piece, self.start, place and (shift + place[0], shift + place[1]), rewrites

    def last(self) -> str:
        return self.out[self.start - self.shift :]


def located(template: Template, messages: list[Message]) -> list[tuple[str, int, tuple[int, int] | None, int | None]]:
    """(piece, start, place of its text, rewrites) of every message, from whole prefixes.  If one rewrites history,
    pieces and places are those of the last output: a piece runs from the end of the text before to the end of its
    own, the last one to the end of all."""
    state, found = Appended(template), []
    for m in messages:
        found.append(state.push(*m))
    out = state.out
    if all(r is None for *_, r in found):
        ends = [start for _, start, *_ in found[1:]] + [len(out)]
        return [(out[start:end], start, place, None) for end, (_, start, place, _) in zip(ends, found)]
    at, rows = 0, []
    for i, (*_, rewrites) in enumerate(found):
        place = _place(template, messages, i, out)
        end = len(out) if i == len(found) - 1 else max(at, place[1] if place else at)
        rows.append((out[at:end], at, place, rewrites))
        at = end
    return rows


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def pieces(conversations: DataFrame, template: Template = chatml, reach: int | None = REACH) -> DataFrame:
    """A row for each turn of conversations(conv_id, turn, role, text): its place (from 0), the piece of the output
    that it brought, where the piece starts, where in the output its own text runs (null if the template leaves it
    out), and in `rewrites` the position from which its coming changed what was there before (else null).  The
    pieces of a conversation in order are its output.

    With a reach a task holds a few turns; without, it holds a conversation."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state, held, waiting = object(), None, [], None

        def rest() -> Iterator[tuple]:
            if waiting:
                yield _row(waiting, state.last())
            for n, ((role, _), (piece, *found)) in enumerate(zip(held, located(template, held) if held else ())):
                yield _row((now, n, role, *found), piece)

        for conv, role, text in turns(batches):
            if conv != now:
                yield from rest()
                now, held, waiting = conv, [], None
                state = Appended(template, reach) if reach is not None else None
            if state is None:
                held.append((role, text))
                continue
            n = state.turns
            piece, *found = state.push(role, text)
            if waiting:
                yield _row(waiting, piece)
            waiting = (conv, n, role, *found)
        yield from rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in PIECES.split(", ")]
        out, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        for row in rows(batches):
            out.append(row)
            size += len(row[3])
            if size > 1 << 20 or len(out) >= 2000:
                yield pack()
                out, size = [], 0
        if out:
            yield pack()

    return _ordered(conversations).mapInArrow(trimmed(run), PIECES)


def _row(turn: tuple, piece: str) -> tuple:
    conv, n, role, start, place, rewrites = turn
    return conv, n, role, piece, start, *(place or (None, None)), rewrites


class Reader:
    """Reads an output of chatml() back as it comes, in pieces cut anywhere: its turns and the text under the mask."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.n_loss = self.chars = 0
        self.rest = ""
        self.mask: list[tuple[int, int]] = []

    def feed(self, piece: str, mask: tuple[int, int] | None) -> None:
        if mask:
            self.mask.append(mask)
        text, base, at = self.rest + piece, self.chars - len(self.rest), 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                raise ValueError("the output holds something between its turns")
            self.n += 1
            self.turns.update(f"{_role(m[1])}\n{unescape(m[2])}\n".encode())
            at = m.end()
        self.chars += len(piece)
        done = []
        for s, e in self.mask:
            if e <= self.chars:
                said = unescape(text[s - base : e - base])
                self.n_loss += len(said)
                self.loss.update(said.encode())
                done.append((s, e))
        self.mask = [x for x in self.mask if x not in done]
        self.rest = text[at:]

    def row(self, conv: int | None) -> tuple:
        if self.rest or self.mask:
            raise ValueError("the output ends inside a turn")
        return conv, self.n, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation of pieces() made with chatml(): its turns, and the text under the loss mask, as they
    stand in the output.  A digest is a chain, so the pieces of a conversation go through one task, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in READ.split(", ")]
        now, reader, out = object(), None, []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        for b in batches:
            for conv, role, piece, s, e in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "piece", "text_start", "text_end"))):
                if conv != now:
                    if reader:
                        out.append(reader.row(now))
                    now, reader = conv, Reader()
                reader.feed(piece, (s, e) if role == LEARNED and s is not None else None)
            if len(out) >= 2000:
                yield pack()
                out = []
        if reader:
            out.append(reader.row(now))
        if out:
            yield pack()

    return formatted.sortWithinPartitions("conv_id", "place").mapInArrow(trimmed(run), READ)


#: Turns of conversation -1: control strings inside texts.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, LEARNED, "</s>[INST] ok [/INST]")]


def with_planted(conversations: DataFrame) -> DataFrame:
    """conversations and the turns of conversation -1."""
    kinds = "conv_id long, turn long, role string, text string"
    return conversations.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in kinds.split(", ")]).union(conversations.sparkSession.createDataFrame(PLANTED, kinds))


_PATTERN = "([<\\[])(\\\\*)(" + "|".join(re.sub(r"([|\[\]/])", r"\\\1", c[1:]) for c in CONTROL) + ")"
ORACLE_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values {", ".join(f"({c}, {n}, '{r}', '{t}')" for c, n, r, t in PLANTED)})
), f as (
  select *, '{START}' || regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '{_PATTERN}', '\\1\\\\\\2\\3', 'g') || chr(10)
    || regexp_replace(text, '{_PATTERN}', '\\1\\\\\\2\\3', 'g') || '{END}' || chr(10) as piece, role = '{LEARNED}' as learned from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (learned), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (learned), '')) as loss_sha256,
  sum(length(piece))::bigint as formatted_chars
from f group by conv_id
"""
