"""Columns over dialogue texts: lines that start with a speaker marker open a turn.

`(?d)` keeps a line feed the only line end; without it Java also breaks lines at a
carriage return and the Unicode separators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speaker markers.
SPEAKERS = ("Doctor", "Patient")
MARKER = "(?:Doctor|Patient):"
LINE_MARKER = f"(?md)^{MARKER}"
_BEFORE_FIRST = f"(?smd)\\A.*?(?=^{MARKER})"
_TURN_BREAK = f"(?md)(?={LINE_MARKER.removeprefix('(?md)')})"
#: Turns a dialogue needs to be cut in halves.
LEAST_TURNS = 4


def strip_ws(text: Column) -> Column:
    """Without white space (of all Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def has_marker(text: Column) -> Column:
    return text.rlike(LINE_MARKER)


def without_preamble(text: Column, strict: bool = True) -> Column:
    """The text from its first marker on.  Without a marker: an error, or the text itself if not strict."""
    body = F.regexp_replace(text, _BEFORE_FIRST, "")
    if not strict:
        return body
    return F.when(text.isNull() | has_marker(text), body).otherwise(F.raise_error(F.lit("dialogue has no speaker marker")))


def preamble_chars(text: Column, body: Column) -> Column:
    return F.length(text) - F.length(body)


def turns(text: Column) -> Column:
    """Trimmed non-empty segments; what precedes the first marker is one of them."""
    return F.filter(F.transform(F.split(text, _TURN_BREAK), strip_ws), lambda x: x != "")


def speaker_turns(text: Column, speaker: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?md)^{speaker}:")).cast("long")


def n_turns(text: Column) -> Column:
    """Size of turns() without building it: a marked segment is never empty, so only a prefix needs a look."""
    prefix = F.regexp_replace(text, r"(?smd)^(?:Doctor|Patient):.*\z", "")
    blank = ~prefix.rlike(r"(?U)\S")
    return (F.regexp_count(text, F.lit(LINE_MARKER)) + F.when(blank, 0).otherwise(1)).cast("long")


def turn_format(text: Column) -> dict[str, Column]:
    """Validity flags of a generated dialogue; no marker at all means no turns."""
    t = strip_ws(text)
    return {
        "starts_with_turn_marker": t.rlike(f"\\A{MARKER}"),
        "num_turns": F.when(has_marker(t), n_turns(t)).otherwise(F.lit(0).cast("long")),
        "has_doctor_turn": speaker_turns(t, "Doctor") > 0,
        "has_patient_turn": speaker_turns(t, "Patient") > 0,
    }


def format_valid(text: Column) -> Column:
    f = turn_format(text)
    return f["starts_with_turn_marker"] & f["has_doctor_turn"] & f["has_patient_turn"]


def halves(text: Column) -> Column:
    """struct(prefix, continuation), each with half of the turns; null with fewer than LEAST_TURNS turns or no marker."""
    t = turns(text)
    n = F.size(t)
    mid = F.floor(n / 2).cast("int")
    pair = F.struct(F.array_join(F.slice(t, F.lit(1), mid), "\n").alias("prefix"), F.array_join(F.slice(t, mid + 1, n - mid), "\n").alias("continuation"))
    return F.when(has_marker(text) & (n >= LEAST_TURNS), pair)
