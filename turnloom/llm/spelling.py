"""Spelling variants: words one edit apart, by a positional q-gram inverted index.

Words are counted in the tasks that read the texts.  A word of L letters has L + 2 positional grams of three
letters (two signs before it and two behind it count as letters).  Two words one inserted, deleted or replaced
letter apart share at least max(L) - 1 of them, at places that differ by one at most; so they share one of
the four rarest grams of each (all but the last of a word's grams may be lost, in any order that both agree on).
Each word is therefore posted under four grams with their places, and asks under the places and lengths
that a variant could have: a posting list holds words of one length with one gram at one place.  In a list, the
other grams of its words are indexed; a word's lists are merged by a heap, the long ones only looked up, words
that reach the bound are verified letter by letter, and a pair counts in the first list where it meets.

A list of more than LONG rows is not merged by one task: its words meet under what remains of them when one letter is
dropped, where no more than letters times length words can meet.  It is the same pairs, and nothing is cut.

Rules for odd rows: a null text has no words; a null doc_id is hashed as the empty text; repeated rows count again.
Columns besides doc_id and text play no part.  An empty table has no words.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import LOWER, id_text, materialise, mix64, signed, trimmed

#: Code points and occurrences of a word at least; one occurrence in so many is misspelt.
LEAST_LETTERS, LEAST_COUNT, DAMAGE = 5, 3, 97
#: A form is at least so many times as frequent.
FORM_RATIO = 2
#: Letters of a gram, and grams under which a word is posted (one edit destroys Q).
Q = 3
POSTED = Q + 1
#: Words counted before a task hands them on.
HELD = 1 << 17
#: Rows of a posting list that one task merges, and words of one that are verified without sifting.
LONG, FEW = 20_000, 3

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
# Signs before and behind a word; letters are 90 of Latin-1, so there are 92 ** Q grams at most.
_BEFORE, _BEHIND = "\x01" * (Q - 1), "\x02" * (Q - 1)


def words(docs: DataFrame) -> DataFrame:
    """word and n: how often each run of letters, some damaged by the rule, occurs in all texts; rare and short ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().translate(LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if not h % DAMAGE:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield pack()
                    held.clear()
        if held:
            yield pack()

    each = id_text(docs).mapInArrow(trimmed(run), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    """The word's grams in order."""
    whole = _BEFORE + word + _BEHIND
    return [whole[i : i + Q] for i in range(len(word) + Q - 1)]


def gram_ranks(vocab: DataFrame) -> dict[str, int]:
    """The grams of vocab(word), numbered from the rarest to the most frequent, equals by code points: 92 ** Q entries at
    most, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for word in b["word"].to_pylist():
                total.update(grams(word))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["g", "n"])

    rows = vocab.select("word").mapInArrow(trimmed(run), "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return {g: i for i, (_, g) in enumerate(sorted(zip(rows["n"].to_pylist(), rows["g"].to_pylist())))}


def posted(own: list[str], ranks: dict[str, int]) -> list[int]:
    """Places of the rarest POSTED grams, rarest first; of equal ones the earlier place."""
    return sorted(range(len(own)), key=[ranks[g] for g in own].__getitem__)[:POSTED]


_POSTINGS = "g int, p int, size int, asks boolean, word string"


def postings(vocab: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """A row for each list (gram by its rank, place, length of its words) that a word stands in (asks: false) or asks as a
    possible variant of longer words (true)."""
    held = vocab.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for word in b["word"].to_pylist():
                own, size = grams(word), len(word)
                at = [(ranks[own[p]], p) for p in posted(own, ranks)]
                asked = {(c, q) for c, p in at for q in (p, p + 1)}  # a gram that stands at p and p + 1 asks at p + 1 once
                for c, p, longer in [*((c, p, 0) for c, p in at), *((c, q, 1) for c, q in asked)]:
                    for column, v in zip(out, (c, p, size + longer, longer > 0, word)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))], ["g", "p", "size", "asks", "word"])

    return vocab.select("word").mapInArrow(trimmed(run), _POSTINGS)


def one_edit(s: str, t: str) -> bool:
    """Whether different words s and t (no longer than t by more than one, nor shorter) are one edit apart."""
    if len(s) > len(t):
        s, t = t, s
    if len(t) - len(s) > 1:
        return False
    i, n = 0, len(s)
    while i < n and s[i] == t[i]:
        i += 1
    return s[i + (len(s) == len(t)) :] == t[i + 1 :]


def _merged(lists: list[list[int]], least: int) -> list[int]:
    """Numbers that stand in at least `least` of the sorted lists: the short ones go through a heap, a number that
    only the others hold can't reach the bound, and in these it is looked up, the shorter ones, which miss more, first."""
    if len(lists) < least:
        return []
    lists.sort(key=len)
    short, long = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    out, now, n = [], -1, 0
    for x in chain(heapq.merge(*short) if len(short) > 1 else short[0], (-1,)):
        if x == now:
            n += 1
            continue
        spare = n - 1  # of least - 1 long lists so many may lack what n short ones hold
        if spare >= 0:
            for y in long:
                i = bisect_left(y, now)
                if i == len(y) or y[i] != now:
                    if not spare:
                        break
                    spare -= 1
            else:
                out.append(now)
        now, n = x, 1
    return out


def _list_pairs(code: int, place: int, size: int, listed: list[str], asking: list[str], ranks: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart that meet in this list first."""
    if not listed:
        return
    if len(listed) <= FEW:  # nothing to sift
        found = [(w, x) for w in asking for x in listed] + [(w, x) for i, w in enumerate(listed) for x in listed[i + 1 :]]
    else:
        found = _sifted(size, listed, asking)
    for s, t in found:
        if one_edit(s, t) and _first(s, t, ranks) == (code, place):
            yield s, t


def _sifted(size: int, listed: list[str], asking: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs that share as many grams as words one edit apart must."""
    index: dict[tuple[int, str], list[int]] = {}
    least, get = size - 1, index.get
    for i, w in enumerate(listed):
        own = list(enumerate(grams(w)))
        lists = []
        for at in own:
            if x := get(at):
                lists.append(x)
            else:
                index[at] = []
        if len(lists) >= least:
            for j in _merged(lists, least):
                yield listed[j], w
        for at in own:
            index[at].append(i)
    for w in asking:
        lists, own = [], grams(w)
        for p, c in enumerate(own):
            a, b = get((p, c)), get((p + 1, c))
            if a or b:
                lists.append(sorted({*a, *b}) if a and b else a or b)
            elif len(lists) + len(own) - p <= least:  # the grams that follow are too few
                break
        if len(lists) >= least:
            for j in _merged(lists, least):
                yield w, listed[j]


def _first(s: str, t: str, ranks: dict[str, int]) -> tuple[int, int] | None:
    """The gram and its place in t (no shorter than s) of the first list where s and t meet."""
    a, b = grams(s), grams(t)
    there = {(b[q], q) for q in posted(b, ranks)}
    for p in posted(a, ranks):
        for q in (p,) if len(s) == len(t) else (p, p + 1):
            if (a[p], q) in there:
                return ranks[a[p]], q
    return None


_PAIR = "a string, b string"


def _pairs_of_lists(rows: DataFrame, ranks: dict[str, int]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, listed, asking, out = None, [], [], ([], [])

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["a", "b"])

        def close() -> None:
            for s, t in _list_pairs(*now, listed, asking, held.value):
                out[0].append(s)
                out[1].append(t)

        for batch in batches:
            for g, p, size, asks, word in zip(*(batch[c].to_pylist() for c in ("g", "p", "size", "asks", "word"))):
                if (g, p, size) != now:
                    if now:
                        close()
                    now, listed, asking = (g, p, size), [], []
                (asking if asks else listed).append(word)
            if len(out[0]) >= 5000:
                yield pack()
                out = ([], [])
        if now:
            close()
        if out[0]:
            yield pack()

    dealt = rows.repartition("g", "p", "size").sortWithinPartitions("g", "p", "size")
    return dealt.mapInArrow(trimmed(run), _PAIR)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def rests(word: str) -> np.ndarray:
    """64-bit hashes of the word and of it without each of its letters, in order: sums of letters times powers, so all
    of them cost one pass."""
    c = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.uint64)
    power = np.cumprod(np.full(len(c), _STEP))
    whole = c * power
    before = np.concatenate([[np.uint64(0)], np.cumsum(whole)])
    behind = np.concatenate([np.cumsum((c[1:] * power[:-1])[::-1])[::-1], [np.uint64(0)]])
    return mix64(np.concatenate([before[-1:], before[:-1] + behind]))


def _pairs_of_rests(rows: DataFrame) -> DataFrame:
    """Pairs of words(word) one edit apart: both leave the same when a letter is dropped, or one is left by the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b["word"].to_pylist()
            found = [np.unique(rests(w)) for w in words]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(words).take(pa.array(np.repeat(np.arange(len(words)), sizes)))], ["rest", "word"])

    left = rows.select("word").distinct().mapInArrow(trimmed(run), "rest long, word string")
    a, b = left.toDF("rest", "a"), left.toDF("rest", "b")
    near = F.udf(one_edit, "boolean", useArrow=True)
    return a.join(b, "rest").where("a < b and abs(length(a) - length(b)) < 2").select("a", "b").distinct().where(near("a", "b"))


def pairs(vocab: DataFrame, long: int = LONG) -> DataFrame:
    """a and b of every two words of vocab(word) that are one edit apart, once."""
    ranks = gram_ranks(vocab)
    rows = materialise(postings(vocab, ranks), "postings")
    crowded = rows.groupBy("g", "p", "size").agg(F.count("*").alias("n")).where(F.col("n") > long).drop("n")
    if crowded.isEmpty():
        return _pairs_of_lists(rows, ranks)
    crowded = materialise(crowded, "crowded")
    some = _pairs_of_lists(rows.join(crowded, ["g", "p", "size"], "left_anti"), ranks)
    rest = _pairs_of_rests(rows.join(crowded, ["g", "p", "size"], "left_semi"))
    return some.union(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(docs: DataFrame) -> DataFrame:
    """A row for each word of docs(doc_id, text): word, its form (the most frequent word one edit apart, by code points
    of equals the first, if that is twice as frequent; else null), the root that forms lead to, n, n_near, form_n."""
    vocab = materialise(words(docs), "words")
    found = materialise(pairs(vocab), "pairs")
    both = found.select("a", "b").union(found.select("b", "a")).toDF("word", "other")
    known = both.join(vocab.toDF("other", "m"), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best"))
    rows = vocab.join(best, "word", "left")
    takes = -F.col("best.m") >= FORM_RATIO * F.col("n")
    rows = rows.select(
        "word", F.when(takes, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.m")).alias("form_n")
    )
    rows = materialise(rows, "forms")
    return rows.join(roots(rows.where("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms(word, form), which run in no circle: each round follows twice as many steps, and forms are
    at least twice as frequent as their words, so there are few."""
    now = forms.toDF("word", "root")
    while True:
        after = now.toDF("root", "__further")
        step = now.join(after, "root", "left")
        step = materialise(step.select("word", F.coalesce("__further", "root").alias("root"), F.col("__further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")


_CRC = (
    "xor(list_reduce(list_transform(range(0, strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::bigint), "
    "lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"
)
ORACLE_SQL = f"""
with recursive crc as (
  select list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, i::bigint)) as t
), runs as (
  select doc_id, run, count(*) as c from (
    select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents
  ) where length(run) >= {LEAST_LETTERS} group by all
), keyed as (
  select doc_id || ':' || run as k, run, c from runs
), hashed as (
  select run, c, {_CRC.format(x="k")} as h from keyed, crc
), damaged as (
  select case when h % {DAMAGE} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from hashed
), v as (
  select word, sum(c)::bigint as n from damaged where length(word) >= {LEAST_LETTERS} group by word having sum(c) >= {LEAST_COUNT}
), d as (
  select distinct word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from (select word, unnest(range(0, length(word))) as i from v)
), near as (
  select a.word, b.word as other from d a join d b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select d.word, v.word from d join v on d.rest = v.word
  union select v.word, d.word from d join v on d.rest = v.word
), ranked as (
  select near.word, other, v.n as m, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by v.n desc, other) as k from near join v on v.word = other
), forms as (
  select v.word, case when m >= {FORM_RATIO} * v.n then other end as form, v.n, coalesce(n_near, 0)::bigint as n_near, case when m >= {FORM_RATIO} * v.n then m end as form_n
  from v left join (select * from ranked where k = 1) r on r.word = v.word
), chain as (
  select word, word as root, 0 as steps from forms union all select chain.word, forms.form, steps + 1 from chain join forms on forms.word = chain.root where forms.form is not null
)
select word, form, root, n, n_near, form_n from forms join (select word, arg_max(root, steps) as root from chain group by word) using (word)
"""
