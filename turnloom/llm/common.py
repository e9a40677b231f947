"""Shared plumbing of the training-data operators.

Texts travel to Python as UTF-8 bytes in Arrow batches.  Byte-level kernels work
on the batch's own buffer in bounded pieces, so one very long text costs no more
memory than many short ones.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.workers import BATCH_BYTES, give_back, small_batches, trimmed  # noqa: F401

#: Bytes of text a kernel handles at once: its arrays fit a core's cache.
PIECE = 1 << 17

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a local session that names none gets one, for tests: on a
    cluster, executors would write to their own disks, so there it must be set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = held.get() if held.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="turnloom-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it cuts the
    lineage and survives lost executors.  The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = _hadoop(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._turnloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() on which nothing lazy depends any more."""
    for t in tables:
        files, p = _hadoop(t.sparkSession, t._turnloom_path)
        files.delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df starts with."""
    taken = {c.lower() for c in df.columns}
    lead = "__tl_"
    while any(c.startswith(lead) for c in taken):
        lead = "_" + lead
    return [lead + n for n in names]


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as UTF-8 bytes, with the other columns asked for and none besides."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def crc_bucket(n: int):
    """crc32 of doc_id written as text, modulo n; a null id is hashed as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column, nulls as empty; offsets start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"")
    wide = pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(n: int, size: int = PIECE) -> Iterator[tuple[int, int]]:
    for s in range(0, n, size):
        yield s, min(n, s + size)


#: Bits of the map that maybe_in() sends to the executors: 16 a key within these bounds.
LEAST_MAP_BITS, MAP_BITS = 16, 26


def maybe_in(df: DataFrame, keys: str | list[str], wanted: DataFrame, others: bool = False) -> DataFrame:
    """The rows of df whose keys may be a row of wanted (columns in the order of keys).  A map of hashed
    keys decides: it errs to yes only, for a fifteenth of the rows at most while wanted has up to
    2^MAP_BITS / 16 rows; fuller maps let more through.  It spares a following join the shuffle of
    long texts that find no partner.  With `others` the remaining rows, which are certainly not in
    it; rows with a null key are among them."""
    spark = df.sparkSession
    keys = [keys] if isinstance(keys, str) else keys
    size = min(MAP_BITS, max(LEAST_MAP_BITS, math.ceil(math.log2(16 * max(1, wanted.count())))))
    h = lambda cs: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cs], F.lit("key map")), F.lit(1 << size))
    bit = F.expr("shiftleft(1L, cast(h & 31 as int))")
    bits = wanted.select(h(wanted.columns).alias("h")).groupBy(F.shiftright("h", 5).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(1 << (size - 5), np.uint32)
    if len(bits):
        words[bits["w"].to_numpy()] = bits["b"].to_numpy().astype(np.uint32)
    held = spark.sparkContext.broadcast(words)
    names = df.columns
    (mark,) = fresh(df, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b[mark].fill_null(0).to_numpy(zero_copy_only=False)
            there = ((held.value[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1) & b[mark].is_valid().to_numpy(zero_copy_only=False)
            yield b.select(names).filter(pa.array(there != others))

    known = F.lit(True)
    for c in keys:
        known &= F.col(f"`{c}`").isNotNull()
    return df.withColumn(mark, F.when(known, h(keys))).mapInArrow(trimmed(run), df.schema)


def without(df: DataFrame, keys: list[str], unwanted: DataFrame) -> DataFrame:
    """The rows of df whose keys are not a row of unwanted; rows with a null key stay."""
    gone = unwanted.toDF(*keys).distinct()
    return maybe_in(df, keys, unwanted, others=True).union(maybe_in(df, keys, unwanted).join(gone, keys, "left_anti").select(*[f"`{c}`" for c in df.columns]))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside (not for what is only planned there)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
