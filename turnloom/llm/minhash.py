"""Near-duplicate groups by MinHash.

Method: one-permutation hashing with optimal densification into 128 bins, 32 bands
of 4 bins, and star-shaped candidate edges.  Documents with equal shingle sets are
one class from the start.  Each bucket of classes gets two stars (to its least and its
greatest class), so candidate pairs stay linear in bucket size; every candidate is
confirmed on full shingle sets.

Buckets that still hold several components after that are finished exactly, and without
meeting all their pairs: of the classes in them every shingle set is ordered by how many
of those sets hold a shingle, and two linked sets must share one of the first quarter
(prefix filtering), at places that leave room for the intersection asked for.  Shingles
that occur in one component only come first and need no partner.  What two sets of
different components meet in is confirmed on full sets.  Nothing is capped.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6, were bins
independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import LOWER, WordHash, batches_of, discard, fresh, materialise, maybe_in, mix64, signed, trimmed, without

WIDTH = 5
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: A link: 100 * intersection >= PERCENT * union, which is 7 * intersection >= 3 * (sum of sizes).
PERCENT = 75
#: Rows of an Arrow batch where rows hold two shingle sets.
PAIRS_AT_ONCE = 64

_MUL = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WIDTH)], np.uint64)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)


def _probes() -> np.ndarray:
    rng = np.random.default_rng(20170)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


#: For each bin the order in which it asks the others for a value while it is empty.
PROBES = _probes()


def shingle_set(ids: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the WIDTH-word shingles; a shorter sequence is one shingle."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, WIDTH)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h += mix64(ids[i : n - k + 1 + i] + np.uint64(i)) * _MUL[i]
        return np.unique(mix64(h ^ np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """One value for each bin: the least hash that falls in it, or for an empty bin
    that of the first bin with a value in its own probe order."""
    at = np.searchsorted(s, _EDGES)
    got = np.minimum(at, len(s) - 1)
    full = (at < len(s)) & (s[got] >> np.uint64(57) == np.arange(BINS, dtype=np.uint64))
    source = PROBES[np.arange(BINS), np.argmax(full[PROBES], axis=1)]
    source[full] = np.arange(BINS)[full]
    return s[got[source]]


def band_hashes(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((mix64(sig + np.arange(BINS, dtype=np.uint64)).reshape(BANDS, ROWS) * _MUL[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes]]]:
    """Batches of at most 256 rows with the set and its digest of each text."""
    hashes = WordHash()
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            sets = [shingle_set(hashes.of((t or b"").translate(LOWER).split())) for t in part["text"].to_pylist()]
            yield part, sets, [xxhash.xxh128_digest(s.tobytes()) for s in sets]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets, digests in _sets(batches):
        bands = [signed(band_hashes(signature(s))) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], part["tie"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "tie", "n_shingles", "digest", "bands"],
        )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose digest is the one asked for: rows may share a doc_id."""
    for part, sets, digests in _sets(batches):
        right = np.array([a == b for a, b in zip(digests, part["digest"].to_pylist())], bool)
        yield pa.RecordBatch.from_arrays([part["id"], pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"]).filter(pa.array(right))


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    if min(len(p), len(q)) * 100 < PERCENT * max(len(p), len(q)):
        return False
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    both = int((q[at] == p).sum())
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = np.zeros(len(b), bool)
        for i, (x, y) in enumerate(zip(b["sa"], b["sb"])):
            keep[i] = linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
        yield b.select(["a", "b"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that are linked when their full sets are compared."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(trimmed(_confirm), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of the edges (a, b): the same root throughout a component.

    Each round contracts every node into its neighbour that comes first in an order
    hashed anew, which halves what is left on average whatever the shape.  A round holds
    only the nodes that still have an edge, so all rounds together are linear.
    """
    maps, k = [], 0
    edges = materialise(edges.where("a <> b").distinct(), "edges0")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        first = F.min_by("v", F.xxhash64(F.col("v"), F.lit(k)))
        near = materialise(both.union(both.select("u", "u")).groupBy("u").agg(first.alias("w")), f"near{k}")
        maps.append(near)
        na, nb = near.toDF("a", "wa"), near.toDF("b", "wb")
        k += 1
        after = edges.join(na, "a").join(nb, "b").where("wa <> wb").select(F.least("wa", "wb").alias("a"), F.greatest("wa", "wb").alias("b")).distinct()
        after = materialise(after, f"edges{k}")
        discard(edges)
        edges = after
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for near in reversed(maps):
        later = out.toDF("w", "root")
        out = near.join(later, "w", "left").select(F.col("u").alias("id"), F.coalesce("root", "w").alias("root"))
    out = materialise(out, "roots")
    discard(edges, *maps)
    return out


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, id, comp, n) for each shingle g of each set."""
    for b in batches:
        for at in range(0, len(b), 64):
            part = b.slice(at, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part["shingles"]]
            n = np.array([len(s) for s in sets])
            cols = [pa.array(np.repeat(part[c].to_numpy(), n)) for c in ("id", "comp")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *cols, pa.array(np.repeat(n, n))], ["g", "id", "comp", "n"])


def _length_class(n: Column) -> Column:
    """Grows with n, by one for each six per cent."""
    return F.floor(F.log2(n.cast("double")) * 12).cast("int")


def across(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes(id, comp) in different components, every linked one among them, by their
    sets (id, shingles): prefix filtering with the order and the bounds on places told at the top.

    Keys of the joins are shingles and lengths.  Those that many sets share make long join
    partitions, which adaptive execution splits, but no rows: a set asks only lengths at which
    its shingle occurs in another component with room for the intersection.
    """
    tokens = materialise(sets.join(nodes, "id").select("id", "comp", "shingles").mapInArrow(trimmed(_shingle_rows), "g long, id long, comp long, n long"), "tokens")
    shared = tokens.groupBy("g").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g", "df")
    shared = materialise(shared, "shared")
    rows = tokens.join(shared, "g").groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("l"))  # a text's shingles
    rows = rows.withColumn("alone", F.col("n") - F.size("l")).withColumn("take", F.expr("cast(n - (3 * n + 3) div 4 + 1 - alone as int)")).where("take > 0")
    rows = rows.select("id", "comp", "n", "alone", F.posexplode(F.slice("l", F.lit(1), F.col("take"))).alias("pos", "x"))
    prefix = rows.select(F.col("x.g").alias("g"), _length_class(F.col("n")).alias("lc"), "id", "comp", "n", (F.col("n") - F.col("alone") - F.col("pos")).alias("rest"))
    prefix = materialise(prefix, "prefix")
    there = prefix.groupBy("g", "lc").agg(*[f(c).alias(f"{c}_{f.__name__}") for c, f in (("comp", F.min), ("comp", F.max), ("n", F.min), ("n", F.max), ("rest", F.max))])
    there = materialise(there, "there")
    # The longer set of a pair asks; the shorter has from lo to hi shingles.
    asking = prefix.withColumn("lo", F.expr("(3 * n + 3) div 4")).withColumn("hi", F.expr("least(n, (7 * rest) div 3 - n)")).where("lo <= hi")
    asking = asking.drop("lc").withColumn("lc", F.explode(F.sequence(_length_class(F.col("lo")), _length_class(F.col("hi")))))
    asking = asking.join(there, ["g", "lc"]).where("(comp_min <> comp or comp_max <> comp) and n_min <= hi and n_max >= lo and 7 * rest_max >= 3 * (n + n_min)")
    asking = materialise(asking.select("g", "lc", "id", "comp", "n", "lo", "hi"), "asking")
    given = prefix.toDF("g", "lc", "id2", "comp2", "n2", "rest2")
    met = asking.join(given, ["g", "lc"]).where("n2 between lo and hi and comp2 <> comp and 7 * rest2 >= 3 * (n + n2) and (n2 < n or id2 < id)")
    pairs = materialise(met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "met")
    discard(tokens, shared, prefix, there, asking)
    return pairs


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, component_id and root (a number of the component, null
    where a row takes no part in links) for each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    sigs = materialise(texts.mapInArrow(trimmed(_signatures), "doc_id long, tie long, n_shingles long, digest binary, bands array<long>"), "sigs")
    classes = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    bands = classes.select("id", F.explode("bands").alias("h"))
    stars = bands.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("c > 1")
    stars = materialise(stars, "stars")
    members = materialise(maybe_in(bands, "h", stars.select("h")).join(stars, "h"), "members")
    pairs = members.select("id", F.explode(F.array("lo", "hi")).alias("o")).where("id <> o").select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    wanted = classes.select("id", "doc", "digest").join(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"), "id")
    wanted = materialise(wanted.select(F.col("doc").alias("doc_id"), "digest", "id"), "wanted")
    same = maybe_in(texts, "doc_id", wanted.select("doc_id")).select("doc_id", "text").join(wanted, "doc_id").select("id", "digest", "text")
    sets = materialise(same.mapInArrow(trimmed(_set_rows), "id long, shingles binary").dropDuplicates(["id"]), "sets")
    with batches_of(spark, PAIRS_AT_ONCE):
        links = materialise(confirmed(pairs, sets), "links")
    roots = components(links)

    # What the stars left open: buckets of three or more classes in several components.
    held = members.where("c > 2").select("h", "id").join(roots, "id", "left").select("h", "id", F.coalesce("root", "id").alias("comp"))
    held = materialise(held, "held")
    mixed = held.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    mixed = materialise(mixed, "mixed")
    nodes = materialise(held.join(mixed, "h").select("id", "comp").distinct(), "nodes")
    pairs2 = across(nodes, sets)
    with batches_of(spark, PAIRS_AT_ONCE):
        links2 = materialise(confirmed(pairs2, sets), "links2")
    part = links2.join(nodes.toDF("a", "ra"), "a").join(nodes.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = components(part)

    own = classes.select("id", "doc", "digest").join(roots, "id", "left").select("doc", "digest", F.coalesce("root", "id").alias("r"))
    own = own.join(merged.toDF("r", "root"), "r", "left").select("doc", "digest", F.coalesce("root", "r").alias("root"))
    own = materialise(own, "own")
    least = materialise(own.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    labels = own.select("digest", "root").join(least, "root").select("digest", "root", "component_id")
    out = sigs.select("doc_id", "tie", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("digest")).alias("digest"))
    out = materialise(out.join(labels, "digest", "left").select("doc_id", "tie", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root"), "groups")
    discard(sigs, classes, stars, members, pairs, wanted, sets, links, roots, held, mixed, nodes, pairs2, links2, merged, own, least)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...); other columns are not read.

    A null or blank text has no shingles and is linked with nothing.  Rows that repeat
    a doc_id are answered row by row, each by its own text; rows with a null doc_id take no part
    in links and get a null component_id and kept true.  An empty table gives an empty result.
    """
    return groups(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate group: that of the least doc_id and, of rows
    that share it, of the least text hash; of equal rows one stays.  Rows without words or without
    a doc_id all stay.  An empty table stays empty."""
    found = groups(docs)
    firsts = found.where("root is not null and doc_id = component_id")
    several = firsts.groupBy("root").agg(F.count("*").alias("c"), F.min("tie").alias("kept_tie")).where("c > 1")
    several = materialise(several, "several")  # empty where each doc_id has one row
    copies = found.where("root is not null and doc_id <> component_id").select("doc_id", "tie")
    twins = firsts.join(several, "root")
    gone = materialise(copies.union(twins.where("tie <> kept_tie").select("doc_id", "tie")).distinct(), "gone")
    again = materialise(twins.where("tie = kept_tie").groupBy("doc_id", "tie").count().where("count > 1").select("doc_id", "tie"), "again")
    names = docs.columns
    keys = fresh(docs, "id", "tie")
    rows = docs.withColumns({keys[0]: F.col("doc_id").cast("long"), keys[1]: F.xxhash64("text")})
    out = without(rows, keys, gone)
    if not again.isEmpty():
        once = maybe_in(out, keys, again).join(again.toDF(*keys), keys, "left_semi").dropDuplicates(keys).select(*[f"`{c}`" for c in rows.columns])
        out = without(out, keys, again).union(once)
    return out.select(*[F.col(f"`{c}`") for c in names])
