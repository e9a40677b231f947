"""Language identification by prediction by partial matching.

Each language has a byte-context tree of contexts up to four bytes; a text is given
the language under whose frozen statistics its code length is least; of equal ones the
first by code point.  The trees are fitted on a bounded sample of labelled rows (`max_docs`,
`max_doc_bytes`), of which every gram is kept; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import PIECE, buffers, give_back, trimmed
from turnloom.llm.ppm import PlainCode, Tree, below, packed

DEPTH = 5
#: Bounds of the fitting sample: documents over all languages, bytes of one.
MAX_DOCS = 2400
MAX_DOC_BYTES = 1 << 16


class Model:
    def __init__(self, langs: list[str], code: PlainCode | None):
        self.langs, self.code = langs, code

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (posterior under equal priors) of each text; `und` and 0.0 for
        a null text, one without letters, or if nothing was learned."""
        data, offsets = buffers(text.cast(pa.binary()))
        n = len(offsets) - 1
        if not self.langs or not n:
            return ["und"] * n, np.zeros(n)
        bits = self.code.bits(data, offsets, PIECE)
        best = bits.argmin(axis=1)
        gain = np.exp2(-(bits - bits.min(axis=1, keepdims=True)))
        score = 1.0 / gain.sum(axis=1)
        letters = has_letter(data, offsets)
        score[~letters] = 0.0
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], score


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    ascii_ = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.nonzero(~out)[0]:
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore")))
    return out


def fit(docs: DataFrame, learn: Column, max_docs: int = MAX_DOCS, max_doc_bytes: int = MAX_DOC_BYTES) -> Model:
    """Trees of the languages of docs(doc_id, text, lang) rows where `learn` holds and text and lang are there.

    A language gives an equal share of max_docs, drawn by a hash of doc_id and text, so rows without an id are
    drawn like others; of equal rows one is learned from.  Of more than max_docs languages those with the
    most rows are learned.  Longer texts than max_doc_bytes are not learned from.  Without any such row the model
    knows no language.  Other columns are not read.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_doc_bytes))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text", F.lit("language sample")).alias("h"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_docs).collect()}
    if not sizes:
        return Model([], None)
    each = max_docs // len(sizes)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.2 * each / n))])
    chance = F.pmod("h", F.lit(1_000_000)) / 1_000_000
    sample = rows.where(chance < share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text")).toArrow()
    langs = sorted(set(sample["lang"].to_pylist()), key=lambda x: [ord(c) for c in x])
    keys, counts = [], []
    for i, lang in enumerate(langs):
        own = sample.filter(pc.equal(sample["lang"], lang))
        own = own.take(pc.sort_indices(own, [("h", "ascending")])).slice(0, each)
        data, offsets = buffers(own["text"].combine_chunks())
        k, c = np.unique(packed(data, np.unique(offsets[:-1]), 0, len(data), DEPTH), return_counts=True)
        keys.append(k)
        counts.append(np.zeros((len(k), len(langs)), np.float32))
        counts[-1][:, i] = c
    del sample
    if not sum(map(len, keys)):
        return Model([], None)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    levels = []
    for d in range(DEPTH, 0, -1):
        keys_d, counts_d = below(keys, counts, d)
        levels.insert(0, (keys_d, counts_d))
    while not len(levels[-1][0]):
        levels.pop()
    model = Model(langs, PlainCode(Tree(levels)))
    del keys, counts, levels
    give_back()
    return model


def predictions(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred and score of every row of docs.

    Of a row only text is used.  A null text and one without letters get `und` and 0.0, and so does any text
    if the model knows no language.  Repeated rows are answered one by one, a null doc_id stays null, an
    empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = held.value.predict(b["text"])
            cols = [b[c] for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep))
    return src.mapInArrow(trimmed(run), f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of `least` or more: null texts and texts
    without letters go, rows are judged one by one, whatever their ids or other columns hold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = held.value.predict(b["text"])
            yield b.filter(pa.array((score >= least) & (np.array(pred, object) != "und"), pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
