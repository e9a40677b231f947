"""Markdown report of a processed dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.dataset import split_counts, stats

LENGTHS = ["note_len_chars", "conversation_len_chars"]
TURNS = ["num_turns", "num_doctor_turns", "num_patient_turns"]


def summary(records: DataFrame, n_raw: int) -> dict[str, float]:
    """Rows read, kept and dropped, and preambles stripped with their share in percent (two decimals)."""
    kept, stripped = records.agg(F.count("*"), F.count_if("preamble_stripped")).first()
    share = lambda a, b: round(100 * a / b, 2) if b else 0.0
    return {"raw": n_raw, "kept": kept, "dropped": n_raw - kept, "kept_pct": share(kept, n_raw), "stripped": stripped, "stripped_pct": share(stripped, kept)}


def data_report(records: DataFrame, splits: DataFrame, n_raw: int) -> str:
    s = summary(records, n_raw)
    out = ["# Data report", "", f"Rows: {s['raw']}; exact copies dropped: {s['dropped']}; kept: {s['kept']} ({s['kept_pct']:.2f}%).", f"Preambles stripped: {s['stripped']} ({s['stripped_pct']:.2f}%).", ""]
    out += ["| Split | Rows | Share |", "|---|---|---|"] + [f"| {r.split} | {r.n} | {r.pct:.1f}% |" for r in split_counts(splits).orderBy("split").collect()]
    out += ["", "| Measure | Mean | Min | Max |", "|---|---|---|---|"] + [f"| {r.metric} | {r.mean} | {r.min} | {r.max} |" for r in stats(records, LENGTHS + TURNS).collect()]
    return "\n".join(out) + "\n"


def one_record(scored: DataFrame) -> str:
    """Scores of a single record, a line each."""
    r = scored.first()
    return "".join(f"{k}: {v:.4f}\n" if isinstance(v, float) else f"{k}: {v}\n" for k, v in r.asDict().items())


def side_by_side(scored: dict[str, DataFrame]) -> str:
    """Scores of a single record under several arms, a line each with a column for each arm."""
    rows = {arm: df.first().asDict() for arm, df in scored.items()}
    shown = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    names = [k for k in next(iter(rows.values())) if k != "note_id"]
    out = ["| | " + " | ".join(rows) + " |", "|---" * (len(rows) + 1) + "|"]
    return "\n".join(out + [f"| {k} | " + " | ".join(shown(r[k]) for r in rows.values()) + " |" for k in names]) + "\n"
