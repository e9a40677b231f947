"""Approximate nearest neighbours by inner product: a hierarchical k-means tree.

Vectors get one more component that makes all lengths equal, which turns the largest
inner product into the least distance.  The tree is fitted on a bounded sample (SAMPLE), is
divided as long as a node holds 2 * LEAST sample rows, however deep that goes, and is sent to
the executors; every vector is put into a leaf.  A query visits leaves best bin first, by a
priority queue over tree nodes.  How many is calibrated: for a bounded sample of queries the
true neighbours are found by brute force over all rows, and visits are widened until RECALL of
them lie in visited leaves.  A query whose leaves hold fewer than k rows besides its own goes
on until they do or no leaf is left.

Neighbouring leaves share a cell of bounded size, a large leaf is several cells, and a query
goes once to each cell in which it visits a leaf, so neither a leaf that holds a third of all
rows nor many small leaves make large groups or many rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import materialise, trimmed

K = 20
#: Rows of the sample that the tree is fitted on; children of a node; sample rows of a leaf at least (about).
SAMPLE, BRANCHES, LEAST = 60_000, 16, 16
#: Queries whose true neighbours are found for calibration, and the recall wanted of them.
TRIALS, RECALL = 128, 0.94
#: Candidates and queries of a cell at most (about).
CELL = 4096


def valid(dim: int):
    return (
        F.col("embedding").isNotNull()
        & (F.size("embedding") == dim)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the nearest centre of each row; fewer centres if rows repeat."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = (own[None, :] == np.arange(len(centres))[:, None]).astype(float) @ x
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, nearest(x, centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


class Tree:
    """Nodes are numbered; children[i] are those of i (none: a leaf), centres[i] lies in its middle."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 7):
        self.longest = longest
        rng = np.random.default_rng(seed)
        x = self.lifted(sample)
        self.centres, self.children = [x.mean(axis=0)], [[]]
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) < 2 * LEAST:
                continue
            centres, own = kmeans(rows, max(2, min(BRANCHES, len(rows) // LEAST)), rng)
            if len(np.unique(own)) < 2:
                continue
            for i, c in enumerate(centres):
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), rows[own == i]))
                self.centres.append(c)
                self.children.append([])
        self.centres = np.array(self.centres)
        self.norms = (self.centres**2).sum(axis=1)

    def leaves(self) -> list[int]:
        """Neighbours in the tree are neighbours in the list."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.children[node]:
                todo += self.children[node]
            else:
                out.append(node)
        return out

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x**2).sum(axis=1), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        x = self.lifted(x)
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                at[rows] = node
                continue
            own = nearest(x[rows], self.centres[kids])
            todo += [(kids[i], rows[own == i]) for i in np.unique(own).tolist()]
        return at

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        far = (self.norms - 2 * self.centres[:, :-1] @ query).tolist()
        heap = [(far[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if kids := self.children[node]:
                for kid in kids:
                    heapq.heappush(heap, (far[kid], kid))
            else:
                yield node


def matrix(col) -> np.ndarray:
    """Rows of a column of float64 bytes."""
    rows = col.to_pylist() if isinstance(col, pa.Array) else list(col)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components, so equal vectors get equal results."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def best(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int, visited: list[np.ndarray] | None = None, leaf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best other candidates, ties to the smaller id;
    with `visited` (leaves of each query) only candidates whose leaf is among them are compared."""
    out_q, out_c, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if visited is not None:
        order = np.argsort(leaf, kind="stable")
        names, start = np.unique(leaf[order], return_index=True)
        rows_of = dict(zip(names.tolist(), np.split(order, start[1:])))
    for s in range(0, len(queries), 64):
        part = queries[s : s + 64]
        if visited is None:
            rough = part @ cands.T
        else:
            rough = np.full((len(part), len(cands)), -np.inf)
            who: dict[int, list[int]] = {}
            for i, asked in enumerate(visited[s : s + 64]):
                for x in asked.tolist():
                    who.setdefault(x, []).append(i)
            for x, qi in who.items():
                if (ci := rows_of.get(x)) is not None:
                    rough[np.ix_(qi, ci)] = part[qi] @ cands[ci].T
        slack = 1e-9 * (1 + np.abs(rough[np.isfinite(rough)]).max(initial=0))
        rough[query_ids[s : s + 64, None] == ids[None, :]] = -np.inf
        if rough.shape[1] > k:
            low = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        else:
            low = np.full(len(part), -np.inf)
        qi, ci = np.nonzero((rough >= low[:, None] - slack) & np.isfinite(rough))
        score = products(part[qi], cands[ci])
        order = np.lexsort((ids[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = rank < k
        out_q.append(qi[keep] + s)
        out_c.append(ci[keep])
        out_s.append(score[keep])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def cells(tree: Tree, sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(leaf, first cell, number of cells) of each leaf that holds rows."""
    out, at, full = [], 0, 0
    for leaf in tree.leaves():
        n = sizes.get(leaf, 0)
        if not n:
            continue
        if full and full + n > CELL:
            at, full = at + 1, 0
        parts = -(-n // CELL)
        out.append((leaf, at, parts))
        full += n
        if parts > 1:
            at, full = at + parts, 0
    return out


def neighbours(vectors: DataFrame, every: int = 20, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, nearest first, ties to the smaller vec_id.

    Queries: rows of vectors(vec_id, embedding, ...) whose vec_id is divisible by `every`; other columns
    are not read.  Rows without id, or whose vector is null, zero, holds null or non-finite components or
    has not the usual dimension, take no part.  Rows that share the query's vec_id are its own; of rows
    that share any other vec_id each is a candidate.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    dim = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        return empty
    rows = rows.where(valid(dim[0]))
    n, longest = rows.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return empty
    chance = F.pmod(F.xxhash64("vec_id", F.hash("embedding"), F.lit("tree sample")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(chance < min(1.0, SAMPLE / n)).select("embedding").toArrow()["embedding"].combine_chunks()
    x = sample.flatten().to_numpy().reshape(-1, dim[0]) if len(sample) else np.zeros((1, dim[0]))
    own_tree = Tree(x, float(np.sqrt(longest)))
    tree = spark.sparkContext.broadcast(own_tree)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["embedding"].flatten().to_numpy().reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(tree.value.leaf(v)), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "leaf", "v"])

    index = materialise(rows.mapInArrow(trimmed(put), "vec_id long, leaf long, v binary"), "index")
    asked = index.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.first("v").alias("v"), F.count("*").alias("own"))
    asked = materialise(asked, "asked")
    width = _calibrated(index, asked, tree, k, recall)
    sizes = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # a row for each leaf
    places = cells(own_tree, sizes)
    held = spark.sparkContext.broadcast((sizes, {leaf: (at, parts) for leaf, at, parts in places}))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, at = held.value
        for b in batches:
            src, cell, leaves = [], [], []
            for i, (row, own) in enumerate(zip(matrix(b["v"]), b["own"].to_pylist())):
                by: dict[int, list[int]] = {}
                met = seen = 0
                for leaf in tree.value.visits(row):
                    if met >= width and seen >= k + own:
                        break
                    met += 1
                    if leaf in at:
                        seen += sizes[leaf]
                        for c in range(at[leaf][0], at[leaf][0] + at[leaf][1]):
                            by.setdefault(c, []).append(leaf)
                src += [i] * len(by)
                cell += by
                leaves += by.values()
            part = b.take(pa.array(src, pa.int64()))
            yield pa.RecordBatch.from_arrays([part["query_id"], pa.array(cell, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), part["v"]], ["query_id", "cell", "leaves", "v"])

    visits = materialise(asked.mapInArrow(trimmed(visit), "query_id long, cell long, leaves array<long>, v binary"), "visits")
    blocks = materialise(visits.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("qs")), "blocks")  # a row for each cell
    salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit("cell")), F.col(n))
    left = visits.join(blocks, "cell").withColumn("q", salt("query_id", "qs").cast("int")).select("cell", "q", "query_id", "leaves", "v")
    # A row for each leaf of the tree, of which the sample bounds the number.
    of_leaf = F.broadcast(spark.createDataFrame(places, "leaf long, first long, parts long"))
    right = index.join(of_leaf, "leaf").withColumn("cell", F.col("first") + salt("vec_id", "parts"))
    right = right.join(blocks, "cell").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select("cell", "q", "vec_id", "leaf", "v")

    def match(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int, "score": float})
        qi, ci, score = best(matrix(q.v), q.query_id.to_numpy(), matrix(c.v), c.vec_id.to_numpy(), k, list(q.leaves), c.leaf.to_numpy())
        return pd.DataFrame({"query_id": q.query_id.to_numpy()[qi], "vec_id": c.vec_id.to_numpy()[ci], "score": score})

    found = left.groupBy("cell", "q").cogroup(right.groupBy("cell", "q")).applyInPandas(match, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(index: DataFrame, asked: DataFrame, tree, k: int, recall: float) -> int:
    """Leaves to visit."""
    spark = index.sparkSession
    trial = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIALS).toArrow().to_pylist()
    if not trial:
        return 1
    ids, q = np.array([r["query_id"] for r in trial]), matrix([r["v"] for r in trial])
    held = spark.sparkContext.broadcast((ids, q))

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's k best of each trial query."""
        ids, q = held.value
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for b in batches:
            cands = b["vec_id"].to_numpy(zero_copy_only=False)
            qi, ci, score = best(q, ids, matrix(b["v"]), cands, k)
            kept = [np.concatenate([x, y]) for x, y in zip(kept, (qi, cands[ci], b["leaf"].to_numpy(zero_copy_only=False)[ci], score))]
            order = np.lexsort((kept[1], -kept[3], kept[0]))
            kept = [x[order] for x in kept]
            first = (np.arange(len(order)) - np.searchsorted(kept[0], kept[0])) < k
            kept = [x[first] for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["i", "vec_id", "leaf", "score"])

    found = index.mapInArrow(truth, "i long, vec_id long, leaf long, score double")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("i", "leaf").collect()  # TRIALS * k rows at most
    places = [{leaf: p for p, leaf in enumerate(tree.value.visits(row))} for row in q]
    ranks = np.sort([places[r["i"]][r["leaf"]] for r in true])
    return int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1
