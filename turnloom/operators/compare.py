"""Comparison of arms over identical records."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import stats
from turnloom.operators.arms import COMPARED, EMBEDDED, METRICS, wide

LABELS = {
    "rouge1": "ROUGE-1", "rougeL": "ROUGE-L", "bertscore_f1": "BERTScore-F1", "numeric_grounding_recall": "Numeric grounding", "fabricated_number_rate": "Fabricated numbers",
}


def comparable(scores: DataFrame, arms: list[str]) -> DataFrame:
    """arm, only_here, only_there: ids that each arm has and the first has not, and the reverse."""
    marks = [F.max((F.col("arm") == a).cast("int")).alias(f"__{i}") for i, a in enumerate(arms)]
    each = scores.groupBy("note_id").agg(*marks)
    sums = each.agg(*[x for i in range(len(arms)) for x in (F.count_if((F.col(f"__{i}") == 1) & (F.col("__0") == 0)).alias(f"h{i}"), F.count_if((F.col(f"__{i}") == 0) & (F.col("__0") == 1)).alias(f"t{i}"))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"h{i}").alias("only_here"), F.col(f"t{i}").alias("only_there")) for i, a in enumerate(arms)])))


def assert_comparable(scores: DataFrame, arms: list[str]) -> None:
    odd = [r for r in comparable(scores, arms).collect() if r.only_here or r.only_there]  # a row for each arm
    if odd:
        raise ValueError("arms differ in records: " + "; ".join(f"{r.arm}: {r.only_here} more, {r.only_there} fewer than {arms[0]}" for r in odd))


def stochastic(arms: DataFrame) -> list[str]:
    """Arms whose decoding samples, so a rerun may differ."""
    return sorted(r[0] for r in arms.where("decoding.do_sample").select("arm").distinct().collect())


def shared_metrics(scores: DataFrame, arms: list[str], metrics: list[str]) -> list[tuple[str, str, str]]:
    """(a, b, metric) of all pairs and the metrics that both arms have."""
    there = [m for m in metrics if m in scores.columns]
    counts = {r.arm: r for r in scores.groupBy("arm").agg(*[F.count(m).alias(m) for m in there]).collect()}
    return [(a, b, m) for a, b in combinations(sorted(arms), 2) for m in there if counts[a][m] and counts[b][m]]


def compare(scores: DataFrame, arms: list[str], metrics: list[str] = [*COMPARED, EMBEDDED], **options) -> DataFrame:
    """arm_a, arm_b, metric, delta, ci_low, ci_high, n, n_resamples, excludes_zero of each pair of arms.

    Arms must have the same records (else it raises); a metric that an arm lacks is left
    out of its pairs.  All pairs share one set of draws and one join.
    """
    arms = sorted(arms)
    assert_comparable(scores, arms)
    wanted = shared_metrics(scores, arms, metrics)
    table = wide(scores, sorted({m for _, _, m in wanted}), arms)
    names = [f"{a}|{b}|{m}" for a, b, m in wanted]
    diffs = table.select("note_id", *[(F.col(f"`{a}|{m}`") - F.col(f"`{b}|{m}`")).alias(f"{a}|{b}|{m}") for a, b, m in wanted])
    out = stats.bootstrap(diffs, "note_id", names, point="delta", **options)
    part = F.split("metric", "\\|")
    low, high = F.col("ci_low"), F.col("ci_high")
    return out.select(*[F.get(part, F.lit(i)).alias(c) for i, c in enumerate(("arm_a", "arm_b", "metric"))], "delta", "ci_low", "ci_high", "n", "n_resamples", stats.excludes_zero(low, high).alias("excludes_zero"))


def markdown(aggregates: DataFrame, valid: DataFrame, deltas: DataFrame) -> str:
    """Tables of arms and of their differences (a row for each arm, metric and pair)."""
    rows = aggregates.collect()
    cells = {(r.arm, r.metric): f"{r.point_estimate:.3f} [{r.ci_low:.3f}, {r.ci_high:.3f}]" for r in rows}
    rates = {r.arm: f"{100 * r.turn_format_valid_rate:.1f}%" for r in valid.collect()}
    out = ["| Arm | " + " | ".join(LABELS.values()) + " | Turn-format valid |", "|---" * (len(LABELS) + 2) + "|"]
    for arm in sorted({r.arm for r in rows}):
        out.append(f"| {arm} | " + " | ".join(cells.get((arm, m), "—") for m in LABELS) + f" | {rates.get(arm, '—')} |")
    pairs: dict[tuple[str, str], list] = {}
    for r in deltas.collect():
        pairs.setdefault((r.arm_a, r.arm_b), []).append(r)
    for (a, b), found in sorted(pairs.items()):
        out += ["", f"### {a} − {b}", "", "| Metric | Delta | 95% CI | Excludes zero |", "|---|---|---|---|"]
        order = {m: i for i, m in enumerate([*METRICS[:3], EMBEDDED, *METRICS[3:]])}
        for r in sorted(found, key=lambda r: order.get(r.metric, 99)):
            out.append(f"| {r.metric} | {r.delta:+.4f} | [{r.ci_low:+.4f}, {r.ci_high:+.4f}] | {'yes' if r.excludes_zero else 'NO'} |")
    return "\n".join(out) + "\n"
