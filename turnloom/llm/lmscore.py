"""Language-model scoring: a word baseline and a byte model by partial matching.

Statistics come from every training document.  Executors count words and byte grams
of their rows and send distinct ones only; sums are shuffled by key.

Word counts stay a distributed table.  Words that hold at least HEAD_SHARE of all
tokens (at most 1 / HEAD_SHARE of them, whatever the corpus) are sent to every
executor; the rest, none of which can be hot, meet their counts in a shuffled join.

The byte model keeps every gram, as distributed tables too.  Its statistics are frozen, so
what a byte costs depends on the gram of full depth that ends there only.  Grams that hold
at least GRAM_SHARE of all positions (at most 1 / GRAM_SHARE) are sent to every executor
with their costs; the others meet theirs in the join of the rare words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import LOWER, WordHash, buffers, crc_bucket, id_text, materialise, pieces, signed, trimmed
from turnloom.llm.ppm import BITS, by_doc, packed

DEPTH = 5
HEAD_SHARE = 1e-5
GRAM_SHARE = 5e-7
#: Distinct words or grams an executor's task holds before it sends them on.
HELD = 400_000
#: The end token: no word holds a line feed.
END = xxhash.xxh64_intdigest(b"\n")
_LOWER = np.frombuffer(LOWER, np.uint8)
#: _MASK[d] keeps the last d bytes of a packed gram and is the greatest gram of d bytes.
_MASK = [(1 << (BITS * d)) - 1 for d in range(DEPTH + 1)]


def _word_rows(words: Counter, ends: int) -> pa.RecordBatch:
    keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    keys, n = np.append(keys, np.uint64(END)), np.append(np.fromiter(words.values(), np.int64, len(words)), ends)
    return _rows(0, keys, n)


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(signed(keys)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate([c for _, c in parts]), len(keys))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    ends = 0
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        for at in range(0, len(b), 512):
            part = b.slice(at, 512)
            for t in part["text"]:
                ends += 1
                if t.is_valid:
                    words.update(t.as_py().translate(LOWER).split())
            if len(words) >= HELD:
                yield _word_rows(words, ends)
                words, ends = Counter(), 0
            data, offsets = buffers(part["text"])
            data, starts = _LOWER[data], np.unique(offsets[:-1])
            for s, e in pieces(len(data)):
                grams.append(np.unique(packed(data, starts, s, e, DEPTH), return_counts=True))
                if sum(len(k) for k, _ in grams) > 4 * HELD:
                    grams = [_merge(grams)]
                    if len(grams[0][0]) > 2 * HELD:
                        yield _rows(1, *grams.pop())
    yield _word_rows(words, ends)
    if grams:
        yield _rows(1, *_merge(grams))


def _shorter(g: Column) -> Column:
    """A packed gram without its oldest byte."""
    out = F.lit(0).cast("long")
    for d in range(2, DEPTH + 1):
        out = F.when(g > _MASK[d - 1], g.bitwiseAND(_MASK[d - 1])).otherwise(out)
    return out


class ByteModel:
    """All grams of 1 to DEPTH bytes and their contexts, as tables; costs as ppm.ExcludingCode has them.

    A packed gram tells its own length, so one table holds all of them.  A gram has at most
    256 events as a context and 256 longer forms, so no key of these joins can be hot.
    """

    def __init__(self, grams: DataFrame):
        levels = F.array(*[F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(_MASK[d]).alias("g")) for d in range(1, DEPTH + 1)])
        each = grams.select(F.explode(levels).alias("x"), "n").select("x.d", "x.g", "n")
        self.events = materialise(each.where(f"shiftright(g, {BITS} * (d - 1)) <> 0").groupBy("g").agg(F.sum("n").alias("n")), "grams")
        rows = self.events.select("n", F.shiftright("g", BITS).alias("c"), _shorter(F.col("g")).alias("p"))
        rows = rows.join(self.events.select(F.col("g").alias("p"), F.col("n").alias("pn")), "p", "left")
        # n, t: occurrences that some byte follows, distinct bytes that do; held: what those bytes have in the shorter context.
        own = rows.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("t"), F.coalesce(F.sum("pn"), F.lit(0)).alias("held"))
        up = own.select(F.col("c").alias("q"), F.col("n").alias("qn"), F.col("t").alias("qt"))
        both = own.withColumn("q", F.when(F.col("c") > 0, _shorter(F.col("c")))).join(up, "q", "left")
        left_t = F.col("qt") - F.col("t")
        left = F.col("qn") - F.col("held") + left_t
        self.contexts = materialise(
            both.select(
                "c",
                F.log((F.col("n") + F.col("t")).cast("double")).alias("every"),
                F.log((F.col("n") + F.col("t")) / F.col("t")).alias("first"),
                F.log(F.greatest(left, F.lit(1)).cast("double")).alias("left"),
                F.when(left_t > 0, F.log(left / left_t)).otherwise(0.0).alias("escape"),
                F.log(F.greatest(256 - F.col("t"), F.lit(1)).cast("double")).alias("new"),
            ),
            "contexts",
        )
        seen = self.events.withColumn("c", F.shiftright("g", BITS)).join(self.contexts, "c")
        #: key, v: nats of the newest byte of each seen gram.
        self.costs = materialise(seen.select(F.col("g").alias("key"), (F.col("every") - F.log(F.col("n").cast("double"))).alias("v")), "costs")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """key, v of distinct grams that are not in costs.

        Tables of grams up to two bytes have 65,792 rows at most and are broadcast; of a longer
        one, at most 65,792 grams of full depth share it.
        """
        x = keys
        for d in range(DEPTH):
            context = F.shiftright("key", BITS)
            at = context.bitwiseAND(_MASK[d])
            table = self.contexts.where(F.col("c").between(_MASK[d - 1] + 1 if d else 0, _MASK[d]))
            table = table.toDF(*[f"{name}{d}" for name in table.columns])
            x = x.withColumn(f"c{d}", F.when(context > _MASK[d - 1], at) if d else at).join(F.broadcast(table) if d < 3 else table, f"c{d}", "left")
            if d:
                table = self.events.where(F.col("g").between(_MASK[d - 1] + 1, _MASK[d])).toDF(f"g{d}", f"n{d}")
                x = x.withColumn(f"g{d}", F.when(F.col("key") > _MASK[d - 1], F.col("key").bitwiseAND(_MASK[d]))).join(F.broadcast(table) if d < 3 else table, f"g{d}", "left")
        # The longest known context escapes, then each shorter one until one knows the byte.
        paid = F.coalesce(*[F.col(f"first{d}") for d in reversed(range(DEPTH))])
        cost = None
        for d in range(DEPTH - 1, 0, -1):
            known = F.when(F.col(f"left{d}").isNotNull(), paid + F.col(f"left{d}")).otherwise(F.col(f"every{d - 1}")) - F.log(F.col(f"n{d}").cast("double"))
            here = F.col(f"n{d}").isNotNull()
            cost = F.when(here, known) if cost is None else cost.when(here, known)
            paid = paid + F.coalesce(f"escape{d}", F.lit(0.0))
        return x.select("key", cost.otherwise(paid + F.col("new0")).alias("v"))


_SCORED = "kind int, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, key long, n long"


def _nats(data: np.ndarray, offsets: np.ndarray, grams: np.ndarray | None, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nats of each text's frequent grams; text, gram and number of the others, of which there are none without a model."""
    out, rare = np.zeros(len(offsets) - 1), [np.zeros(0, np.uint64)]
    starts = np.unique(offsets[:-1])
    for s, e in pieces(len(data)) if grams is not None else ():
        keys, inv = np.unique(packed(data, starts, s, e, DEPTH), return_inverse=True)
        j = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        head = grams[j] == keys
        by_doc(out, np.where(head, costs[j], 0.0)[inv], offsets, s, e)
        at = np.flatnonzero(~head[inv])
        own = np.searchsorted(offsets, at + s, "right") - 1
        # A gram takes DEPTH * BITS bits, a text's number in its slice of 512 rows the next nine.
        rare.append(own.astype(np.uint64) << np.uint64(BITS * DEPTH) | keys[inv[at]])
    both, n = np.unique(np.concatenate(rare), return_counts=True)
    return out, (both >> np.uint64(BITS * DEPTH)).astype(np.int64), signed(both & np.uint64(_MASK[DEPTH])), n


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, grams, costs = held.value
        hashes = WordHash()
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                m = len(part)
                ids = rid + np.arange(m)
                rid += m
                tokens, own, key, n = np.ones(m, np.int64), [], [], []
                for i, t in enumerate(part["text"].to_pylist()):
                    words = Counter((t or b"").translate(LOWER).split())
                    tokens[i] += words.total()
                    own.append(np.full(len(words) + 1, i))
                    key.append(np.append(hashes.of(list(words)), np.uint64(END)))
                    n.append(np.append(np.fromiter(words.values(), np.int64, len(words)), 1))
                own, key, n = np.concatenate(own), np.concatenate(key), np.concatenate(n)
                j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                head = keys[j] == key
                known = np.bincount(own[head], n[head], m).astype(np.int64)
                base = np.bincount(own[head], n[head] * logs[j[head]], m).astype(float)
                data, offsets = buffers(part["text"])
                nats, rare_own, rare_key, rare_n = _nats(_LOWER[data], offsets, grams, costs)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), pa.array(ids), part["doc_id"], part["held_out"], pa.array(tokens), pa.array(known), pa.array(base), pa.array(-nats / np.log(10)), none, none],
                    _NAMES,
                )
                tail = ~head
                k = int(tail.sum())
                blank = [pa.nulls(k, x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(ids[own[tail]]), *blank, pa.array(signed(key[tail])), pa.array(n[tail])], _NAMES)
                k = len(rare_own)
                blank = [pa.nulls(k, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                out = part["held_out"].take(pa.array(rare_own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 2, np.int32)), pa.array(ids[rare_own]), pa.nulls(k, pa.int64()), out, *blank, pa.array(rare_key), pa.array(rare_n)], _NAMES)

    return run


_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text is empty: one end token, score 0.  Rows that repeat a doc_id are scored
    one by one.  With no training document at all N and V are 0 and every known count too.
    """
    texts = id_text(docs, (crc_bucket(7) == 2).alias("held_out"))
    counted = materialise(texts.where("not held_out").mapInArrow(trimmed(_count), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counted.where("kind = 0 and n > 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = words.where(F.col("n") >= max(1, total * HEAD_SHARE)).toPandas()
    keys = head.key.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, logs = keys[order], np.log10(head.n.to_numpy().astype(float) + 1)[order]
    if not len(keys):
        keys, logs = np.zeros(1, np.uint64), np.zeros(1)
    values = words.select(F.lit(1).alias("kind"), "key", F.log10(F.col("n") + F.lit(1.0)).alias("v"))
    grams = counted.where("kind = 1").select("key", "n")
    positions = grams.agg(F.sum("n")).first()[0] or 0
    often, costs = None, np.zeros(1)
    if positions:
        model = ByteModel(grams)
        sent = model.costs.join(grams.where(F.col("n") >= positions * GRAM_SHARE).select("key"), "key").toPandas().sort_values("key")
        if len(sent):
            often, costs = sent.key.to_numpy().astype(np.uint64), sent.v.to_numpy().astype(float)
        else:
            often = np.zeros(1, np.uint64)
    spark = docs.sparkSession
    both = materialise(texts.mapInArrow(trimmed(_scorer(spark.sparkContext.broadcast((keys, logs, often, costs)))), _SCORED), "scored")
    if positions:
        unseen = both.where("kind = 2 and held_out").select("key").distinct().join(model.costs, "key", "left_anti")
        values = values.union(model.costs.union(model.unseen(unseen)).select(F.lit(2).alias("kind"), "key", "v"))
    tail = both.where("kind > 0").select("kind", "rid", "key", "n").join(values, ["kind", "key"])
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    tail = tail.groupBy("rid").agg(of(1, F.col("n")).alias("more"), of(1, F.col("n") * F.col("v")).alias("more_base"), of(2, F.col("n") * F.col("v")).alias("more_nats"))
    out = both.where("kind = 0").join(tail, "rid", "left")
    weight = float(np.log10(total + distinct + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * weight).alias("base_score"),
        (F.col("score") - F.coalesce("more_nats", F.lit(0.0)) / float(np.log(10))).alias("score"),
    )
