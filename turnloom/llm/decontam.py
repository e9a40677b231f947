"""Benchmark decontamination by winnowing.

A document's winnowing fingerprints are the least hash of K consecutive words in each
sliding window of SPAN - K + 1 such hashes, so every shared span of SPAN words shares
one.  Fingerprints are looked up among the benchmark's; what they hit is extended to
whole windows of SPAN words and compared as such, by 64-bit hashes of their words.  Items of fewer words are one window
of their own length and are looked up by it.

The benchmark is the stated query set.  It is sent to the executors in blocks of at most
BLOCK_BYTES of text (about; rows are dealt to blocks by hash), a pass over the documents
for each block, so what is broadcast stays bounded however long the benchmark is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import WordHash, discard, fresh, materialise, maybe_in, mix64, trimmed

SPAN = 13
K = 5
BLOCK_BYTES = 16 << 20
#: Bytes of text whose words are held at once, except that a text is not divided.
PART_BYTES = 4 << 20

#: Words: lower-case ASCII letters, digits and bytes over 0x7F; all else divides them.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MUL = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(SPAN)], np.uint64)

def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs of ids."""
    out = np.full(max(0, len(ids) - k + 1), k, np.uint64)
    for i in range(k):
        out += ids[i : i + len(out)] * _MUL[i]
    return mix64(out)


def fingerprints(ids: np.ndarray) -> np.ndarray:
    """Of each window of SPAN words the least hash of K words in it."""
    low = grams(ids, K)
    have, want = 1, SPAN - K + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[: max(0, len(low) - step)], low[step:])
        have += step
    return low


class Index:
    """Windows of benchmark items as arrays: sorted hashes, and behind each the numbers of the items that hold it.  A window
    takes some twenty bytes."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]]):
        hashes = WordHash()
        marks: list[np.ndarray] = [np.zeros(0, np.uint64)]
        names: dict[str | None, int] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            ids = hashes.of(words(text))
            if not len(ids):
                continue
            n = min(len(ids), SPAN)
            if n == SPAN:
                marks.append(np.unique(fingerprints(ids)))
            own = np.unique(grams(ids, n))
            found.setdefault(n, []).append((own, np.full(len(own), names.setdefault(item, len(names)), np.int32)))
        self.marks = np.unique(np.concatenate(marks))
        self.names = list(names)
        #: For each length: hashes, where the items of each start (and the last end), numbers of items.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in found.items():
            h, who = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((who, h))
            h, who = h[order], who[order]
            new = np.append(True, h[1:] != h[:-1])
            again = np.append(False, (h[1:] == h[:-1]) & (who[1:] == who[:-1]))  # an item_id that repeats
            starts = np.cumsum(~again) - 1
            self.windows[n] = h[new], np.append(starts[new], (~again).sum()).astype(np.int32), who[~again]

    def nbytes(self) -> int:
        return self.marks.nbytes + sum(x.nbytes for w in self.windows.values() for x in w)

    def holders(self, n: int, at: Iterable[int]) -> set[str | None]:
        """Items that hold any of the windows of n words at these places."""
        _, starts, who = self.windows[n]
        return {self.names[i] for k in at for i in who[starts[k] : starts[k + 1]].tolist()}

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, starts, places among the known) of the windows of ids that occur in items."""
        for n, (known, _, _) in self.windows.items():
            if len(ids) < n:
                continue
            if n == SPAN:
                at = np.nonzero(among(fingerprints(ids), self.marks))[0]
                h = np.full(len(at), SPAN, np.uint64)
                for i in range(SPAN):
                    h += ids[at + i] * _MUL[i]
                h = mix64(h)
            else:
                h = grams(ids, n)
                at = np.arange(len(h))
            ok = among(h, known)
            yield n, at[ok], np.searchsorted(known, h[ok])


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _parts(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    s = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= PART_BYTES:
            yield s, i + 1
            s, size = i + 1, 0
    if s < len(texts):
        yield s, len(texts)


def _sorted(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def scan(texts: list[bytes | None], index: Index, hashes: WordHash) -> Iterator[tuple[int, list[int], list[str | None], int]]:
    """(words, spans hit as flat start and end, items, words hit) of each text."""
    for s, e in _parts(texts):
        lists = [words(t) for t in texts[s:e]]
        sizes = np.array([len(x) for x in lists])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.concatenate([hashes.of(x) for x in lists])
        step = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str | None]] = {}
        for n, at, k in index.matches(ids):
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[doc + 1]
            at, k, doc = at[inside], k[inside], doc[inside]
            np.add.at(step, at, 1)
            np.add.at(step, at + n, -1)
            firsts = np.flatnonzero(np.diff(doc, prepend=-1))  # starts ascend, and so do their documents
            for f, t in zip(firsts.tolist(), [*firsts[1:].tolist(), len(doc)]):
                items.setdefault(int(doc[f]), set()).update(index.holders(n, np.unique(k[f:t]).tolist()))
        hit = np.cumsum(step)[:-1] > 0
        for d in range(len(lists)):
            mask = hit[offsets[d] : offsets[d + 1]] if d in items else np.zeros(0, bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            yield int(sizes[d]), edges.tolist(), _sorted(items.get(d, set())), int(mask.sum())


def together(spans: list[int]) -> list[int]:
    """Spans (flat start and end) that may overlap as spans that don't."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2])):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).toArrow()
        yield Index(list(zip(part["item"].to_pylist(), part["text"].to_pylist())))


def scanned(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with four more columns, and their names, which no column of docs has: words, spans hit (flat), items and words hit.

    The first block is looked up in one pass.  If there are more, what that gives is written with a key for each row,
    every further block gives the keys and spans of the rows that it hits, and only these rows are joined."""
    spark = docs.sparkSession
    own = docs.schema
    *more, row, new_spans, new_items = fresh(docs, "words", "spans", "items", "hit", "row", "new_spans", "new_items")
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.LongType())
    lists = pa.list_(pa.int32()), pa.list_(pa.string())
    schema = T.StructType([*own.fields, *[T.StructField(c, kind) for c, kind in zip(more, kinds)]])
    out = held = None
    later: list[DataFrame] = []
    for index in blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def whole(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for b in batches:
                got = list(scan(b["text"].cast(pa.binary()).to_pylist(), sent.value, hashes))
                n, spans, items, hit = zip(*got) if got else ((), (), (), ())
                cols = [b[c.name] for c in own] + [pa.array(n, pa.int64()), pa.array(spans, lists[0]), pa.array(items, lists[1]), pa.array(hit, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*own.names, *more])

        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for b in batches:
                got = scan(b["text"].cast(pa.binary()).to_pylist(), sent.value, hashes)
                found = [(r, spans, items) for r, (_, spans, items, hit) in zip(b[row].to_pylist(), got) if hit]
                cols = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *lists))], [row, new_spans, new_items])

        if out is None:
            out = docs.mapInArrow(trimmed(whole), schema)
            continue
        if held is None:
            held = materialise(out.withColumn(row, F.monotonically_increasing_id()), "scanned")
        later.append(materialise(held.select("text", row).mapInArrow(trimmed(hits), f"`{row}` long, `{new_spans}` array<int>, `{new_items}` array<string>"), "block"))
        sent.unpersist()
    if held is None:
        return out, more
    each = reduce(DataFrame.union, later).groupBy(row).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in (new_spans, new_items)])  # a row has one of each block
    each = materialise(each, "hits")
    discard(*later)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [together((x or []) + (y or [])) for x, y in zip(b[more[1]].to_pylist(), b[new_spans].to_pylist())]
            items = [_sorted({*(x or ()), *(y or ())}) for x, y in zip(b[more[2]].to_pylist(), b[new_items].to_pylist())]
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            cols = [b[c.name] for c in own] + [b[more[0]], pa.array(spans, lists[0]), pa.array(items, lists[1]), pa.array(hit, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*own.names, *more])

    some = maybe_in(held, row, each.select(row)).join(each, row, "left").mapInArrow(trimmed(merged), schema)
    rest = maybe_in(held, row, each.select(row), others=True).select(*[F.col(f"`{c}`") for c in schema.names])
    return some.union(rest), more


def is_contaminated(hit: str, words: str):
    return (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(words))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs(doc_id, text, ...).

    A null or wordless text has no words and no hits.  Repeated rows are answered one by
    one and other columns are not read; items that repeat an item_id count once.  Items with a null item_id hit like others,
    count as one item in n_items and add nothing to the digest.  An empty benchmark hits nothing.
    """
    out, (words_, _, items, hit) = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return out.select(
        "doc_id",
        F.col(words_).alias("n_words"),
        F.col(hit).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(hit, words_).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, all columns.

    Null and wordless texts stay, repeated rows are judged one by one, null ids and other columns need no rule;
    an empty benchmark lets every row stay.
    """
    out, (words_, _, _, hit) = scanned(docs, benchmark)
    return out.where(~is_contaminated(hit, words_)).select(*[F.col(f"`{c}`") for c in docs.columns])
