"""Alignment of two tokenizers' tokens over the same bytes, by a transducer of dangling suffixes.

Each text is encoded twice.  The transducer takes tokens from one side and the other: its state is the side that leads
and the bytes by which it does.  The side that lags gives the next token; where that leads to is remembered by state and
token, so bytes are compared once for each such pair.  A state without bytes closes a group.  Each step after the
first of a group joins the last token of either side, and these are all pairs of tokens whose bytes overlap (links).

How many documents hold a pair of ids linked is counted over the whole corpus: first within a task, then by shuffle.
The counts come back to the documents on two ways that add up exactly: the HEAD most frequent pairs are sent to the
executors (so many rows whatever the corpus), the rare others meet their documents in a join, where a pair has
few partners because it is rare.

The tokenizer files are parameters; the driver reads them and sends their bytes (two vocabularies) to the executors.

Rules for odd rows: a text that is null, empty or not made up by the tokens' bytes has no tokens, so zeros and an empty
digest.  Rows are answered one by one, so repeated rows and null doc_ids each get a row and each count as a document.
Columns besides doc_id and text play no part.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import id_text, materialise, trimmed

#: Pairs of ids whose counts are sent to the executors, and steps that a worker remembers.
HEAD, REMEMBERED = 1 << 20, 1 << 19
#: Bits of an id in a pair.
BITS = 20
#: Pairs that a task counts before it hands them on.
HELD = 1 << 21
# Fixed value: how the byte-level vocabulary cuts texts before it merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: bytes of a text -> ids, and the bytes of each id.
Side = tuple[Callable[[str], list[int]], list[bytes]]


def public_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def byte_level(data: bytes) -> Side:
    """The byte-level vocabulary in the bytes of a JSON file; strings of special tokens are plain text.  Merges
    that are numbered as they apply are ranks, with which a faster encoder gives the same ids."""
    spec = json.loads(data)
    model, letters = spec["model"], _letters()
    special = {t["id"] for t in spec.get("added_tokens", [])}
    table: list[bytes] = [b""] * (max([*model["vocab"].values(), *special]) + 1)
    for word, i in model["vocab"].items():
        table[i] = bytes(letters[c] for c in word) if i not in special else word.encode()
    for t in spec.get("added_tokens", []):
        table[t["id"]] = t["content"].encode()
    joined = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if joined == list(range(256, 256 + len(joined))):
        import tiktoken

        ranks = {table[i]: i for i in model["vocab"].values() if i not in special}
        return tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, table
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(data.decode())
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids, table


def piece_model(data: bytes) -> Side:
    """The piece model in the bytes of a file; it adds the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda text: model.encode(text, num_threads=1), table


class State:
    """The bytes by which one side leads, and where tokens of the other have been seen to lead from here."""

    __slots__ = ("rest", "a_leads", "to")

    def __init__(self, rest: bytes, a_leads: bool):
        self.rest, self.a_leads, self.to = rest, a_leads, {}


#: Steps of a run: side A opens a group, A gives a token, B gives one.
OPENS, GIVES_A, GIVES_B = 0, 1, 2


class Transducer:
    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self.closed = State(b"", True)
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple[bytes, bool], State] = {}
        self.size = 0
        self.opened = [self._state(x, True) for x in self.a]

    def _state(self, rest: bytes, a_leads: bool) -> State:
        if not rest:
            return self.closed
        found = self.states.get((rest, a_leads))
        if found is None:
            found = self.states[rest, a_leads] = State(rest, a_leads)
        return found

    def _step(self, state: State, token: int) -> State:
        """Where the lagging side's token leads to."""
        rest, new, a_leads = state.rest, (self.b if state.a_leads else self.a)[token], state.a_leads
        if rest.startswith(new):
            left = rest[len(new) :]
        else:
            left, a_leads = new[len(rest) :], not a_leads
            if not new.startswith(rest):
                raise ValueError("the sides differ in bytes")
        self.size += 1
        out = state.to[token] = self._state(left, a_leads)
        return out

    def run(self, a: list[int], b: list[int]) -> bytearray:
        """The steps over two tokenizations of the same bytes: each token of either side once, in order."""
        if self.size >= REMEMBERED:
            self._forget()
        opened, closed, step = self.opened, self.closed, self._step
        steps = bytearray()
        note = steps.append
        each_a, next_b = iter(a), iter(b).__next__
        next_a = each_a.__next__
        for x in each_a:
            note(OPENS)
            state = opened[x]
            while state is not closed:
                if state.a_leads:
                    note(GIVES_B)
                    y = next_b()
                    state = state.to.get(y) or step(state, y)
                else:
                    note(GIVES_A)
                    y = next_a()
                    state = state.to.get(y) or step(state, y)
        return steps


def traced(steps: bytearray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends of the groups in a, in b, links as pairs) of a run over ids a and b: a step that opens no group joins the last
    token of either side."""
    kind = np.frombuffer(steps, np.uint8)
    upto_b = np.cumsum(kind == GIVES_B)
    upto_a = np.arange(1, len(kind) + 1) - upto_b
    opens = kind == OPENS
    links = ~opens
    last = np.append(np.flatnonzero(opens)[1:] - 1, len(kind) - 1)
    return upto_a[last], upto_b[last], a[upto_a[links] - 1] << BITS | b[upto_b[links] - 1]


class Decimals:
    """Writes ids below a bound."""

    def __init__(self, bound: int):
        width = len(str(max(1, bound - 1)))
        ids = np.arange(bound)
        powers = 10 ** np.arange(width - 1, -1, -1)
        self.digits = (ids[:, None] // powers % 10 + ord("0")).astype(np.uint8)
        self.shown = (ids[:, None] >= powers) | (powers == 1)

    def written(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3` of ids and the ends of the groups."""
        n, width = len(a) + len(b), self.digits.shape[1]
        place_a = np.arange(len(a)) + np.repeat(np.append(0, ends_b[:-1]), np.diff(ends_a, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(ends_a, np.diff(ends_b, prepend=0))
        ids = np.empty(n, np.int64)
        ids[place_a], ids[place_b] = a, b
        out, shown = np.empty((n, width + 1), np.uint8), np.ones((n, width + 1), bool)
        out[:, :width], shown[:, :width] = self.digits[ids], self.shown[ids]
        out[:, width] = ord(",")
        out[place_a[ends_a - 1], width] = ord("|")
        out[place_b[ends_b - 1], width] = ord(";")
        shown[-1, width] = False
        return out[shown].tobytes()


def _packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    first = keys >> BITS
    parts = np.diff(first, prepend=0).astype(np.uint32), (keys & (1 << BITS) - 1).astype(np.uint32), times.astype(np.uint32)
    return pa.Codec("zstd", 1).compress(b"".join(p.tobytes() for p in parts), asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and how often a document links them."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, other, times = np.frombuffer(pa.Codec("zstd").decompress(data, 12 * n, asbytes=True), np.uint32).reshape(3, n).astype(np.int64)
    return np.cumsum(first) << BITS | other, times


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary"


@lru_cache(1)
def _loaded(a: bytes, b: bytes) -> tuple[Side, Side, Transducer, Decimals]:
    """Once in a worker."""
    one, other = byte_level(a), piece_model(b)
    return one, other, Transducer(one[1], other[1]), Decimals(max(len(one[1]), len(other[1])))


def _aligned(text: str, loaded: tuple) -> tuple | None:
    """(n_a, n_b, n_groups, n_links, digest, n_pairs, pairs) of a text, None if it has no tokens."""
    (encode_a, bytes_a), (encode_b, bytes_b), transducer, decimals = loaded
    spaced = " " + text
    a, b, whole = encode_a(spaced), encode_b(text), spaced.encode()
    if b"".join(map(bytes_a.__getitem__, a)) != whole or b"".join(map(bytes_b.__getitem__, b)) != whole:
        return None
    ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
    ends_a, ends_b, links = traced(transducer.run(a, b), ids_a, ids_b)
    digest = hashlib.sha256(decimals.written(ids_a, ids_b, ends_a, ends_b)).hexdigest()
    keys, times = np.unique(links, return_counts=True)
    return len(a), len(b), len(ends_a), len(links), digest, len(keys), _packed(keys, times)


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each row of docs: sizes, digest of its groups, and its pairs of linked ids, packed."""
    sides = []
    for path in (a, b):
        with open(path, "rb") as f:
            sides.append(f.read())
    held = docs.sparkSession.sparkContext.broadcast(tuple(sides))
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(*held.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                said = text.as_buffer().to_pybytes().decode() if text.is_valid else ""
                rows.append((doc, *(said and _aligned(said, loaded) or (0, 0, 0, 0, "", 0, b""))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return id_text(docs).mapInArrow(trimmed(run), _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and n: how many rows of aligned() hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def pack() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for n, data in zip(batch["n_pairs"].to_pylist(), batch["pairs"]):
                held.append(_unpacked(data.as_buffer(), n)[0])
                size += n
                if size >= HELD:
                    yield pack()
                    held, size = [], 0
        if size:
            yield pack()

    return rows.select("n_pairs", "pairs").mapInArrow(trimmed(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _least_of_head(counts: DataFrame, most: int) -> int:
    """The least count of which no more than `most` pairs reach it: counts are put into 1024 classes at most."""
    level = F.when(F.col("n") < 16, F.col("n")).otherwise(F.floor(F.log2("n") * 16)).cast("int")
    classes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("least")).collect()
    total, least = 0, None
    for r in classes:
        total += r.c
        if total > most:
            break
        least = r.least
    return least if least is not None else 1 << 62


def tokens(docs: DataFrame, a: str | None = None, b: str | None = None, head: int = HEAD) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best (links whose documents are
    as many as the most of their A id), count_sum (documents of its links, added up), groups_sha256.

    a: file of the byte-level vocabulary; b: file of the piece model; by default public ones.  head only routes."""
    spark = docs.sparkSession
    rows = aligned(docs, a or public_file("byte_bpe_50k.json"), b or public_file("piece_bpe_32k.model"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(rows), "pairs")
    first = F.shiftright("pair", BITS)
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # ids of side A at most
    most = best.toArrow()
    top = np.zeros(int(most["a"].to_numpy().max()) + 1 if len(most) else 1, np.int64)
    top[most["a"].to_numpy()] = most["most"].to_numpy()
    least = _least_of_head(counts, head)
    frequent = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    held = spark.sparkContext.broadcast((frequent["pair"].to_numpy()[order], frequent["n"].to_numpy()[order], top))

    def known(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are in the head, and where."""
        keys = held.value[0]
        at = np.searchsorted(keys, pairs)
        return (keys[np.minimum(at, len(keys) - 1)] == pairs if len(keys) else np.zeros(len(pairs), bool)), at

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, top = held.value
        for batch in batches:
            sums, bests = [], []
            for size, data in zip(batch["n_pairs"].to_pylist(), batch["pairs"]):
                pairs, times = _unpacked(data.as_buffer(), size)
                there, at = known(pairs)
                c = n[at[there]]
                sums.append(int((c * times[there]).sum()))
                bests.append(int(times[there][c == top[pairs[there] >> BITS]].sum()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], [*kept, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list, list] = [], [], []
            for row, size, data in zip(batch["row"].to_pylist(), batch["n_pairs"].to_pylist(), batch["pairs"]):
                pairs, times = _unpacked(data.as_buffer(), size)
                out = ~known(pairs)[0]
                for column, x in zip(found, (np.full(int(out.sum()), row), pairs[out], times[out])):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in found], ["row", "pair", "times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    frequent_sums = rows.mapInArrow(trimmed(add), kinds)
    others = counts.where(F.col("n") < least).join(F.broadcast(best.withColumnRenamed("a", "first")), first == F.col("first"))
    others = others.select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    met = rows.select("row", "n_pairs", "pairs").mapInArrow(trimmed(rare), "row long, pair long, times long").join(others, "pair")
    rare_sums = met.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = lambda x, more: (F.col(x) + F.coalesce(more, F.lit(0))).alias(x)
    return frequent_sums.join(rare_sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best", "more_best"), whole("count_sum", "more_sum"), "groups_sha256"
    )
