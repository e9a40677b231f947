"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the bucket in which a source's budget runs
out is refined alone, level by level, until a threshold on the hash is known to the last
bit.  Documents below it are taken: a filter, no sort.  Nested: a smaller budget takes a
subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import fresh, materialise, trimmed

WEIGHTS = (5, 2, 1)
#: A source is used this often at most.
REPEATS = 3
BITS, LEVELS = 12, 4
#: Sources that are sent to every executor; more of them are joined by shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: list[tuple[str | None, int]]) -> list[float]:
    """The words each source shall give, in the order of `sizes` (by code point, null last):
    shares by weight of the sum of all sizes, none above REPEATS times its size."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    total, full = sum(n for _, n in sizes), set()
    while True:
        left = total - sum(REPEATS * sizes[i][1] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = {i for i, w in enumerate(weights) if i not in full and w * left > REPEATS * sizes[i][1] * weight}
        if not over:
            return [float(REPEATS * n) if i in full else w * left / weight for i, (w, (_, n)) in enumerate(zip(weights, sizes))]
        full |= over


def _hash():
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    """The columns of `keep` and three more, and their names, which no column of docs has: source as text,
    size (words) and hash of doc_id of every row."""
    own, size, h = more = fresh(docs, "source", "size", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len((t.as_py() or b"").split()) for t in b["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), b[own], pa.array(n, pa.int64()), b[h]], [*keep, *more])

    cols = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]
    src = docs.select(*cols, F.col("source").cast("string").alias(own), _hash().alias(h))
    fields = {f.name: f for f in src.schema.fields}
    names = [*(fields[c] for c in keep), fields[own], T.StructField(size, T.LongType()), T.StructField(h, T.LongType())]
    return src.mapInArrow(trimmed(run), T.StructType(names)), more


def thresholds(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(s, source_size, target, full, threshold) for each source of rows(source, size, h), and whether the table
    is small: documents of s are taken `full` times, and once more if their hash is under the threshold.
    The sources and their sizes go through the driver: a row for each."""
    spark = rows.sparkSession
    found = [(r[0], int(r[1])) for r in rows.groupBy("source").agg(F.sum("size")).collect()]  # a row for each source
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    plan = [(s, n, t, int(t // n) if n else 0) for (s, n), t in zip(found, targets(found) if found else [])]
    plan = [(s, n, t, f, t - f * n) for s, n, t, f in plan]
    held = spark.createDataFrame(plan, "source string, source_size long, target double, full long, rest double")
    small = len(plan) <= BROADCAST_SOURCES
    # Of each source: bits known of the threshold, words below it.
    edge = held.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.withColumnRenamed("source", "s").join(_given(edge, small), F.expr("s <=> source") & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("source", "rest", "under", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("prefix")
        sums = sums.withColumn("upto", F.col("under") + F.sum("size").over(order)).where("upto > rest")
        edge = sums.groupBy("source").agg(F.min_by(F.struct("rest", "prefix", (F.col("upto") - F.col("size")).alias("under")), "prefix").alias("x")).select("source", "x.*")
        edge = materialise(edge, f"edge{level}")
    last = edge.select(F.col("source").alias("edge_source"), F.col("prefix").alias("threshold"))
    known = held.join(_given(last, small), F.expr("source <=> edge_source"), "left")
    return known.select(F.col("source").alias("s"), "source_size", "target", "full", "threshold"), small


def _given(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _taken(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of `keep`, size, source_size, target and taken of every row of docs."""
    rows, more = sized(docs)
    known, small = thresholds(materialise(rows.toDF("source", "size", "h"), "sizes"))
    rows, (own, size, h) = sized(docs, *keep)
    names = fresh(rows, "s", "source_size", "target", "full", "threshold")
    s, source_size, target, full, threshold = names
    out = rows.join(_given(known.toDF(*names), small), F.col(own).eqNullSafe(F.col(s)))
    taken = F.col(size) * (F.col(full) + F.when(F.col(threshold).isNull() | (F.col(h) < F.col(threshold)), 1).otherwise(0))
    cols = (F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), F.when(F.col(source_size) > 0, taken).otherwise(0).cast("long").alias("taken"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *cols)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of it) of every row of docs(doc_id, text, source, ...).

    A null text has size 0.  A null source is a source of its own, the last; a null doc_id is hashed
    as the empty text.  Rows that repeat a doc_id share its hash, so they are taken or left together.  The
    same rows give the same mix, however they are partitioned.  Other columns are not read; an empty table
    gives an empty result.
    """
    return _taken(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, all columns (except any that are called size, source_size, target or
    taken), with those four as mix() has them; texts are not shuffled.  Empty texts are never taken."""
    new = ("size", "source_size", "target", "taken")
    return _taken(docs, *[c for c in docs.columns if c.lower() not in new]).where("taken > 0")


ORACLE_SQL = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substring(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as h
  from documents
), totals as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from sized group by source
), weighed as (
  select *, [5, 2, 1][((k - 1) % 3 + 1)::int] as w, (select sum(source_size) from totals) as total from totals
), filled as (
  select 0 as step, list({'k': k, 'w': w, 's': source_size, 'f': false} order by k) as l, any_value(total) as total from weighed
  union all
  select step + 1, n, total from (
    select step, l, total,
      list_transform(l, lambda x: {'k': x.k, 'w': x.w, 's': x.s, 'f': x.f or
        x.w * (total - list_sum(list_transform(l, lambda y: case when y.f then 3 * y.s else 0 end)))
          > 3 * x.s * list_sum(list_transform(l, lambda y: case when y.f then 0 else y.w end))}) as n
    from filled) where n <> l
), last as (
  select l, total from filled order by step desc limit 1
), target as (
  select x.k as k, case when x.f then (3 * x.s)::double else
      (x.w * (total - list_sum(list_transform(l, lambda y: case when y.f then 3 * y.s else 0 end))))::double
      / list_sum(list_transform(l, lambda y: case when y.f then 0 else y.w end)) end as target
  from (select unnest(l) as x, l, total from last)
), plan as (
  select source, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as full_times from totals join target using (k)
)
select s.doc_id, s.size, p.source_size, p.target,
  (s.size * (p.full_times + case when sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row)
     <= p.target - p.full_times * p.source_size then 1 else 0 end))::bigint as taken
from sized s join plan p on s.source is not distinct from p.source
"""
