"""Secret scans: fixed patterns, and values in credential context by guess cost.

The guess cost of a value is that of its cheapest division into words, dates, repeats,
keyboard walks and brute-force spans (in decimal digits of guesses, by dynamic
programming).  A value that follows a credential name and costs LEAST_COST or more is a
secret even where no fixed pattern holds.  Offsets are code points.

Words are ranked: a short list of frequent passwords and settings, then the words of public
byte-pair vocabularies (WORDS_FILES, a parameter; one of many languages), whose order of merges is
one of frequency.  A file that is not there raises; without files the short list is all there is.

Placeholders (`<your-token>`, `${NAME}`) are no secrets, quoted or not.  A value ends where a letter of a
script that is written without blanks begins: what follows is a sentence.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import trimmed

LEAST_COST = 10.0
LEAST_LENGTH = 8
#: Kinds of spans in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, which are the matches of [0-9a-f]+ with 16 characters or more.
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth)["']?[\x20\t]*[:=]{1,2}[\x20\t]*(?:["']([^"'\s]+)["']|((?>[^\s"',;:<>(){}\[\]]+))(?![:<({\[]))""",
    re.ASCII | re.IGNORECASE,
)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")

#: Ranked words in the form that tiktoken reads: base64 of a token and its rank on each line.
WORDS_FILES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Letters of a word of these files.
WORD = re.compile(r"\x20?([^\W\d_]{3,20})")
#: What stands where a value goes.
PLACEHOLDER = re.compile(r"<[^<>]*>|\$?\{+[^{}]*\}+|\$\([^()]*\)|%\([^()]*\)s?|%\w+%|\$[A-Z_][A-Z0-9_]*|\[[^\[\]]*\]|[xX*.…]{4,}", re.ASCII)
#: Letters of scripts without blanks (Thai to Tibetan, Burmese, Khmer, kana, Han).
UNPARTED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Frequent words of passwords and of settings, most frequent first.
COMMON_WORDS = """password admin welcome login master dragon monkey letmein qwerty iloveyou princess sunshine
football baseball shadow superman michael jordan hunter secret test guest user root default changeme
summer winter spring autumn monday friday january july august october december love hello charlie
daniel jessica ashley thomas andrew joshua soccer hockey killer george batman trustno ninja mustang
access flower cookie computer internet server system service database example sample temp demo
company office private public token key pass word apple google orange banana cheese pepper ginger
tiger lion eagle falcon phoenix silver golden diamond crystal freedom money lucky magic purple
true false none null required optional enabled disabled localhost environment something anything
unknown undefined redacted placeholder string value""".split()
#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Rows of the keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_DAY, _MONTH, _YEAR, _GAP = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d", r"[-/._]?"
_YEAR_COST, _DATE_COST = math.log10(120), math.log10(365 * 120)
#: Dates; at one place each matches in one way at most.
DATES = tuple(
    (re.compile(p), c)
    for p, c in ((_YEAR, _YEAR_COST), (_YEAR + _GAP + _MONTH + _GAP + _DAY, _DATE_COST), (_DAY + _GAP + _MONTH + _GAP + _YEAR, _DATE_COST), (_MONTH + _GAP + _DAY + _GAP + _YEAR, _DATE_COST))
)
#: Each piece after the first costs this much for the ways to order pieces.
JOIN = 0.5
#: Costs of a word's capitals, of stand-ins for its letters, of the length of a repeat or walk, and of a walk's start and direction.
CAPITALS, STAND_INS, LENGTH, WALK = 0.5, 0.6, 1.5, math.log10(47 * 8)


@lru_cache(maxsize=4)
def dictionary(paths: tuple[str, ...] | None = WORDS_FILES) -> dict[str, int]:
    """Rank of each word, from 1: the least of its places in the lists of the files, each after COMMON_WORDS."""
    common = {w: i for i, w in enumerate(COMMON_WORDS, 1)}
    out = dict(common)
    for path in paths or ():
        with open(path, "rb") as f:
            ranked = sorted((int(n), base64.b64decode(token)) for token, n in map(bytes.split, f))
        found = dict.fromkeys(m[1].lower() for _, t in ranked if (m := WORD.fullmatch(t.decode("utf-8", "replace"))))
        for i, w in enumerate((w for w in found if w not in common), len(common) + 1):
            out[w] = min(i, out.get(w, i))
    return out


def _charset(value: str) -> float:
    sizes = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9\x80-\U0010ffff]", 33), (r"[\x80-\U0010ffff]", 100))
    return math.log10(sum(n for p, n in sizes if re.search(p, value)) or 10)


def step(a: str, b: str) -> tuple[int, int] | None:
    """From a to b: (0, 0) for the same character, else the way to a neighbour on the keyboard, None if it is no neighbour."""
    if a == b:
        return 0, 0
    p, q = _PLACE.get(a), _PLACE.get(b)
    d = (q[0] - p[0], q[1] - p[1]) if p and q else (9, 9)
    return d if max(map(abs, d)) <= 1 else None


def guess_cost(value: str, ranks: dict[str, int] | None = None, enough: float = math.inf) -> float:
    """Decimal digits of the guesses that the cheapest division of value takes; 0 for an empty one.

    Repeats (one character) and walks (one direction) have three characters or more.  If the
    cost is `enough` or more, some number from `enough` up to the cost may be returned instead.
    """
    ranks = dictionary() if ranks is None else ranks
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LOOKALIKES)
    char = _charset(value)
    longest = max(map(len, ranks), default=0) if len(ranks) < 1000 else 20
    best = [0.0] + [math.inf] * n
    brute = math.inf  # the cheapest division whose last piece is brute force
    dates: dict[int, list[tuple[int, float]]] = {}
    straight, before = math.inf, None  # the cheapest division before a repeat or walk that goes on, and its step
    join = lambda i: best[i] + (JOIN if i else 0.0)
    for j in range(1, n + 1):
        if value[j - 1].isdigit():
            for pattern, cost in DATES:
                if m := pattern.match(value, j - 1):
                    dates.setdefault(m.end(), []).append((j - 1, cost))
        brute = min(join(j - 1), brute) + char
        least = brute
        for i, cost in dates.pop(j, ()):
            least = min(least, join(i) + cost)
        for i in range(max(0, j - longest), j - 2):
            if best[i] + JOIN < least or not i:
                for form, extra in ((low[i:j], 0.0), (plain[i:j], STAND_INS)):
                    if (rank := ranks.get(form)) is not None:
                        least = min(least, join(i) + math.log10(rank + 1) + extra + (CAPITALS if value[i:j] != low[i:j] else 0.0))
        now = step(low[j - 2], low[j - 1]) if j > 1 else None
        straight = min(straight, join(j - 3)) if now is not None and now == before else math.inf
        before = now
        least = min(least, straight + LENGTH + (char if now == (0, 0) else WALK))
        best[j] = least
        # Whatever piece comes next starts at one of these.
        if not j % 64 and (floor := min(straight, brute, *best[max(0, j - max(longest, 12)) : j + 1])) >= enough:
            return floor
    return best[n]


def spans(text: str, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of every secret, by start, then kind as in KINDS."""
    out: list[tuple[int, int, str, int]] = []
    low = text.lower()
    if any(k in low for k in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text) and any(k in low for k in _HINTS):
        taken = sorted((v, e) for _, e, _, v in out)
        at, upto = 0, 0  # values that start before a candidate's end, and the last end among them
        for m in CONTEXT.finditer(text):
            g = 1 if m[1] is not None else 2
            s, e = m.span(g)
            if unparted := UNPARTED.search(text, s, e):
                e = unparted.start()
            while at < len(taken) and taken[at][0] < e:
                upto, at = max(upto, taken[at][1]), at + 1
            if e - s >= LEAST_LENGTH and upto <= s and not PLACEHOLDER.fullmatch(text, s, e) and guess_cost(text[s:e], ranks, LEAST_COST) >= LEAST_COST:
                out.append((s, e, "guess", s))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found)


def redacted(text: str, mark: str = "<secret>", ranks: dict[str, int] | None = None) -> str:
    """text with the value of every secret replaced; overlapping ones as one."""
    out, at = [], 0
    for s, e in sorted((v, e) for _, e, _, v in spans(text, ranks)):
        if e <= at:
            continue
        out += [text[at:s], mark] if s > at or not out else []
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, words_files: tuple[str, ...] = WORDS_FILES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs(doc_id, text, ...).

    A null text is empty: no spans, the digest of the empty list.  A null doc_id stays null.
    Repeated rows are answered one by one; other columns, whatever their names, are not read.
    Spans that start at one place come in the order of KINDS.  An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionary(words_files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            sha, every = [], []
            for t in b["text"]:
                found = spans(t.as_py() or "", held.value)
                base = [x for x in found if x[2] != "guess"]
                for k, v in n.items():
                    v.append(sum(x[2] == k for x in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *(pa.array(v, pa.int64()) for v in n.values()), pa.array(sha, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(trimmed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, words_files: tuple[str, ...] = WORDS_FILES) -> DataFrame:
    """docs, every row and column in place, with the secrets of text replaced and n_chars, if there, brought up to date.

    Null texts and texts without secrets stay as they are.  Rows are treated one by one, so null
    ids and repeated rows need no rule; columns besides text and n_chars are handed on untouched.
    """
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(dictionary(words_files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b["text"].to_pylist()
            new = [None if t is None else redacted(t, ranks=held.value) for t in old]
            cols = {c: b[c] for c in names} | {"text": pa.array(new, b["text"].type)}
            if "n_chars" in names:
                length = b["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([n if x == y else len(y) for n, x, y in zip(length, old, new)], b["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return docs.mapInArrow(trimmed(run), docs.schema)
