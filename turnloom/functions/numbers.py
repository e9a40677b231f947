"""Numbers in texts and how far a generated text is grounded in its note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a number.  ASCII digits; a sign or a thousands comma is not part of it.
NUMBER = r"\d+(?:\.\d+)?"


def numbers(text: Column) -> Column:
    """Distinct values as doubles: 5, 5.0 and 05 are one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda x: x.cast("double")))


def faithfulness(note: Column, generated: Column) -> dict[str, Column]:
    """Of number sets: recall of the note's, precision of the generated one's; 1 if there are none to miss."""
    both, n, g = F.size(F.array_intersect(note, generated)), F.size(note), F.size(generated)
    precision = F.when(g == 0, 1.0).otherwise(both / g)
    return {
        "numeric_grounding_recall": F.when(n == 0, 1.0).otherwise(both / n),
        "numeric_precision": precision,
        "fabricated_number_rate": F.lit(1.0) - precision,
        "n_note_numbers": n.cast("long"),
        "n_generated_numbers": g.cast("long"),
    }


def invented(note: Column, generated: Column) -> Column:
    """Generated numbers that the note lacks, ascending."""
    return F.array_sort(F.array_except(generated, note))
