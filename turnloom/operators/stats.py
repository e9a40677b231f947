"""Percentile bootstrap of means and of paired differences, record by record at any number of records.

A resample draws as many records as there are, with replacement.  Records stand in blocks of BLOCK by their place
in hash order.  How many of a resample's draws fall into each block is counted first (draws are numbered, and
numbers are dealt to tasks); each block then draws so many of its own records, where they are.  Given the
counts of the blocks, draws within a block are uniform, so the whole is the multinomial of the n records, and no
draw travels: a block gets RESAMPLES counts and gives as many sums.  All metrics share the draws, so they go
through them at once, and the difference of two arms' resample means is the resample mean of their differences.

Draw number x in place y of resample b is a hash of 62 bits modulo what there is to draw from, in arithmetic that SQL
has too, so that a plain query can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import order
from turnloom.sources import io

RESAMPLES, LEVEL, SEED = 1000, 0.95, 42
#: Records that are drawn from together, draws that a row of the counting job stands for, and draws that are hashed at once.
BLOCK, COUNTED, AT_ONCE = 4096, 1 << 22, 1 << 16
#: A word of a hash: its bits, and the factors and shifts that mix them.
WORD, FACTORS, SHIFTS = (1 << 31) - 1, (0x21F0AAAD, 0x735A2D97), (16, 15, 15)


def mixed(x):
    """x, one number or many, with every bit of the word spread over all others."""
    x = x ^ (x >> SHIFTS[0])
    x = (x * FACTORS[0]) & WORD
    x = x ^ (x >> SHIFTS[1])
    x = (x * FACTORS[1]) & WORD
    return x ^ (x >> SHIFTS[2])


def starts(seed: int, stage: int) -> tuple[int, int]:
    """What the two words of a stage's hashes start from."""
    return tuple(mixed((mixed(seed & WORD) + 2 * stage + word + 1) & WORD) for word in (0, 1))


def draws(seed: int, stage: int, b, x, y):
    """Hashes of 62 bits of (b, x, y); stage 0 takes y high and x low bits of a draw's number, stage 1 a block and a number in it."""
    high, low = (mixed((mixed((mixed(s ^ b) + x) & WORD) + y) & WORD) for s in starts(seed, stage))
    return (high << 31) | low


def _modulo(x: np.ndarray, n: int) -> np.ndarray:
    return (x.view(np.uint64) % np.uint64(n)).view(np.int64)


def block_counts(spark: SparkSession, n: int, resamples: int, seed: int) -> DataFrame:
    """block, b, c: how many of the n draws of resample b fall into each block of BLOCK records (none: no row)."""
    if n <= BLOCK:
        return spark.range(resamples).select(F.lit(0).cast("long").alias("block"), F.col("id").alias("b"), F.lit(n).cast("long").alias("c"))
    parts = -(-n // COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["id"].to_pylist():
                b, part = divmod(i, parts)
                c = np.zeros(-(-n // BLOCK), np.int64)
                for s in range(part * COUNTED, min(n, (part + 1) * COUNTED), AT_ONCE):
                    x = np.arange(s, min(n, s + AT_ONCE), dtype=np.int64)
                    c += np.bincount(_modulo(draws(seed, 0, np.int64(b), x & WORD, x >> 31), n) // BLOCK, minlength=len(c))
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), b)), pa.array(c[at])], ["block", "b", "c"])

    return spark.range(resamples * parts).mapInArrow(run, "block long, b long, c long").groupBy("block", "b").agg(F.sum("c").alias("c"))


def _sums(block: int, values: np.ndarray, b: np.ndarray, c: np.ndarray, seed: int) -> np.ndarray:
    """For each resample sum and number of the values (rows by metrics, nan for null) that c draws of it take."""
    n = len(values)
    both = np.concatenate([np.nan_to_num(values), ~np.isnan(values)], axis=1).astype(float)
    out = np.empty((len(b), both.shape[1]))
    step = max(1, AT_ONCE // max(1, int(c.max(initial=1)), n))
    for s in range(0, len(b), step):
        times = c[s : s + step]
        which = np.repeat(np.arange(len(times)), times)
        number = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        picks = _modulo(draws(seed, 1, b[s : s + step][which], np.int64(block), number), n)
        out[s : s + step] = np.bincount(which * n + picks, minlength=len(times) * n).reshape(-1, n) @ both
    return out


def bootstrap(records: DataFrame, key: str, metrics: list[str], resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED, point: str = "point_estimate") -> DataFrame:
    """metric, point, ci_low, ci_high, n, n_resamples for each numeric column of `metrics`.

    Records are placed by the hash order of `key`.  Nulls of a metric are left out of its means.
    Empty records raise.
    """
    spark = records.sparkSession
    path = io.scratch(spark, "records")
    held = [f"m{i}" for i in range(len(metrics))]
    records.select(F.col(key).alias("key"), *[F.col(f"`{m}`").cast("double").alias(h) for m, h in zip(metrics, held)]).write.parquet(path)  # what made them runs once
    records = spark.read.parquet(path)
    placed, total = order.ranked(records, "key", seed, "pos")
    n = total.first()[0]
    if not n:
        raise ValueError("bootstrap of no records")
    names = [f"{x}{i}" for x in "sc" for i in range(len(metrics))]

    def drawn(own: pa.Table, counts: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        values = np.stack([own[f"m{i}"].to_numpy() for i in range(len(metrics))], axis=1).astype(float)
        b = counts["b"].to_numpy()
        sums = _sums(counts["block"][0].as_py(), values, b, counts["c"].to_numpy(), seed) if len(b) else np.zeros((0, len(names)))
        return pa.table([pa.array(b), *(pa.array(x) for x in sums.T)], ["b", *names])

    rows = placed.select(((F.col("pos") - 1) / BLOCK).cast("long").alias("block"), "pos", *held)
    counts = block_counts(spark, n, resamples, seed)
    drawn = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(drawn, "b long, " + ", ".join(f"{x} double" for x in names))
    means = drawn.groupBy("b").agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"c{i}")).alias(m) for i, m in enumerate(metrics)])
    low = (1 - level) / 2
    bounds = means.agg(*[F.percentile(m, F.array(F.lit(low), F.lit(1 - low))).alias(m) for m in metrics])
    points = records.agg(*[F.avg(h).alias(f"{m}__point") for m, h in zip(metrics, held)])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.round(f"{m}__point", 6).alias(point), F.round(F.get(m, F.lit(0)), 6).alias("ci_low"), F.round(F.get(m, F.lit(1)), 6).alias("ci_high"))
        for m in metrics
    ])
    return bounds.crossJoin(points).select(F.inline(rows)).select("*", F.lit(n).cast("long").alias("n"), F.lit(resamples).cast("long").alias("n_resamples"))


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def paired_deltas(a: DataFrame, b: DataFrame, key: str, metrics: list[str], **options) -> DataFrame:
    """metric, delta (a - b), ci_low, ci_high, n, n_resamples, excludes_zero; the keys of both must be the same, else it raises.
    A record whose metric is null on either side is left out of that metric."""
    sides = [x.select(key, F.lit(True).alias(f"__{k}"), *[F.col(m).alias(f"__{k}_{m}") for m in metrics]) for k, x in (("a", a), ("b", b))]
    both = sides[0].join(sides[1], key, "full_outer")
    odd = both.where("__a is null or __b is null").count()
    if odd:
        raise ValueError(f"{odd} records are not in both arms")
    diff = both.select(key, *[(F.col(f"__a_{m}") - F.col(f"__b_{m}")).alias(m) for m in metrics])
    return bootstrap(diff, key, metrics, point="delta", **options).withColumn("excludes_zero", excludes_zero(F.col("ci_low"), F.col("ci_high")))


def bootstrap_like_pcg64(values: list[float], resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED) -> tuple[float, float, float]:
    """(mean, low, high) with NumPy's generator, on the driver: for parity with tools that draw so."""
    x = np.asarray(values, dtype=float)
    if not len(x):
        raise ValueError("bootstrap of no records")
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(resamples)])
    low = 100 * (1 - level) / 2
    return float(x.mean()), *map(float, np.percentile(means, [low, 100 - low]))
