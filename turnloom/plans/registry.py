"""Queries of the library by name, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import dialogue, leak, numbers, text
from turnloom.operators import arms, compare, contamination, continuation, dataset, embedscore, order, packing, retrieval, stats, wordvectors
from turnloom.operators.rouge import rouge
from turnloom.plans import sql
from turnloom.plans.fixtures import dialogues, distinct_notes, notes, pairs, stripped, table
from turnloom.sources import io
from turnloom.workers import small_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def bounded(spark, d):
            small_batches(spark)
            return f(spark, d)

        QUERIES[name or f.__name__] = bounded
        if oracle:
            ORACLE[name or f.__name__] = oracle
        return f

    return add


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# Dialogues.


@query(sql.query("select conv_id, i - 1 as idx, case when t like 'Doctor:%' then 'Doctor' else 'Patient' end as role, t as turn_text from (select conv_id, unnest(turns) as t, generate_subscripts(turns, 1) as i from b)", "b"))
def dialogue_turns(spark, d):
    rows = stripped(spark, d).select("conv_id", F.posexplode(dialogue.turns(F.col("conversation"))).alias("idx", "turn_text"))
    return rows.select("conv_id", F.col("idx").cast("long").alias("idx"), F.regexp_extract("turn_text", "^(Doctor|Patient):", 1).alias("role"), "turn_text")


@query(sql.query("select conv_id, conversation, chars_stripped from b", "b"))
def strip_preamble(spark, d):
    rows = stripped(spark, d)
    return rows.select("conv_id", "conversation", dialogue.preamble_chars(F.col("raw"), F.col("conversation")).cast("long").alias("chars_stripped"))


_COUNTS = "conv_id, len(turns) as num_turns, len(list_filter(turns, lambda x: x like 'Doctor:%')) as num_doctor_turns, len(list_filter(turns, lambda x: x like 'Patient:%')) as num_patient_turns"


@query(sql.query(f"select {_COUNTS} from b", "b"))
def turn_counts(spark, d):
    c = F.col("conversation")
    return stripped(spark, d).select("conv_id", dialogue.n_turns(c).alias("num_turns"), dialogue.speaker_turns(c, "Doctor").alias("num_doctor_turns"), dialogue.speaker_turns(c, "Patient").alias("num_patient_turns"))


def _stats_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as metric, round(avg({c}), 1) as mean, min({c})::bigint as min, max({c})::bigint as max from {source}" for c in columns)


_TURNS = ["num_turns", "num_doctor_turns", "num_patient_turns"]


@query(sql.query(_stats_sql("c", _TURNS), "b", f"c as (select {_COUNTS} from b)"))
def turn_stats(spark, d):
    return dataset.stats(turn_counts(spark, d), _TURNS)


@query(_stats_sql("(select length(text) as note_len_chars from documents)", ["note_len_chars"]) + " union all " + sql.query(_stats_sql("(select length(conversation) as conversation_len_chars from b)", ["conversation_len_chars"]), "b").replace("with recursive", "(with recursive", 1) + ")")
def length_stats(spark, d):
    note = table(spark, d, "documents").select(F.length("text").alias("note_len_chars"))
    said = stripped(spark, d).select(F.length("conversation").alias("conversation_len_chars"))
    return dataset.stats(note, ["note_len_chars"]).union(dataset.stats(said, ["conversation_len_chars"]))


@query(sql.query("select count(*) as n, count(*) filter (chars_stripped > 0) as stripped, round(100.0 * count(*) filter (chars_stripped > 0) / count(*), 2) as pct from b", "b"))
def preamble_rate(spark, d):
    hit = F.length("raw") > F.length("conversation")
    return stripped(spark, d).agg(F.count("*").alias("n"), F.count_if(hit).alias("stripped"), F.round(F.count_if(hit) * 100.0 / F.count("*"), 2).alias("pct"))


@query(sql.query(f"select conv_id, {sql.flags('raw')} from d", "d"))
def turn_format(spark, d):
    return dialogues(spark, d).select("conv_id", *[v.alias(k) for k, v in dialogue.turn_format(F.col("raw")).items()])


@query(sql.query(f"select count(*) as n, round(avg((starts_with_turn_marker and has_doctor_turn and has_patient_turn)::int), 6) as valid_rate from (select {sql.flags('raw')} from d)", "d"))
def format_valid(spark, d):
    return dialogues(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(dialogue.format_valid(F.col("raw")).cast("int")), 6).alias("valid_rate"))


_HALVES = "h as (select conv_id, array_to_string(turns[1:len(turns) // 2], chr(10)) as prefix, array_to_string(turns[len(turns) // 2 + 1:], chr(10)) as continuation from b where len(turns) >= 4)"


@query(sql.query("select * from h", "b", _HALVES))
def dialogue_halves(spark, d):
    return stripped(spark, d).select("conv_id", dialogue.halves(F.col("conversation")).alias("h")).where("h is not null").select("conv_id", "h.prefix", "h.continuation")


# Notes and the dataset.


@query("select doc_id, 'note-' || substring(sha256(text), 1, 16) as note_id from documents")
def note_id(spark, d):
    return notes(spark, d).select("doc_id", "note_id")


@query("select doc_id, length(text) as n_chars from documents")
def text_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(sql.query("select doc_id, note_id from u", "u"))
def dedup_exact(spark, d):
    return dataset.deduplicated(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "note_id")


@query(sql.query("select doc_id, note_id, kept_doc_id from (select doc_id, note_id, min(doc_id) over (partition by note_id) as kept_doc_id from n) where doc_id > kept_doc_id", "n"))
def dropped_dupes(spark, d):
    return dataset.dropped(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").withColumnRenamed("kept", "kept_doc_id")


@query("select count(*) as raw, count(*) - count(distinct text) as dropped, count(distinct text) as kept, round(100.0 * count(distinct text) / count(*), 2) as kept_pct from documents")
def coverage(spark, d):
    sizes = notes(spark, d).groupBy("note_id").agg(F.count("*").alias("c"))
    raw, kept = F.sum("c"), F.count("*")
    return sizes.agg(raw.alias("raw"), (raw - kept).alias("dropped"), kept.alias("kept"), F.round(kept * 100.0 / raw, 2).alias("kept_pct"))


@query(sql.query("select note_id, split from x", "u", sql.splits("x", "(select note_id from u)")))
def split_assign(spark, d):
    return dataset.split(distinct_notes(spark, d).select("note_id"))


@query(sql.query("select split, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1) as pct from x group by split", "u", sql.splits("x", "(select note_id from u)")))
def split_counts(spark, d):
    return dataset.split_counts(split_assign(spark, d))


@query(sql.query("select count(*) - count(distinct note_id) as n_overlap, count(distinct note_id) as n_ids, count(*) as n_rows from x", "u", sql.splits("x", "(select note_id from u)")))
def split_overlap_check(spark, d):
    return dataset.overlap(split_assign(spark, d))


@query(sql.query("select x.note_id, split, doc_id, length(text) as note_len_chars from x join u using (note_id)", "u", sql.splits("x", "(select note_id from u)")))
def split_join(spark, d):
    return split_assign(spark, d).join(distinct_notes(spark, d), "note_id").select("note_id", "split", "doc_id", F.length("text").cast("long").alias("note_len_chars"))


@query(sql.query(f"select note_id from u order by {sql.md5_order(42, 'note_id')} limit 200", "u"))
def sample_n(spark, d):
    return order.first_n(distinct_notes(spark, d).select("note_id"), "note_id", 200, dataset.SEED)


@query(sql.query("select note_id, length(text) as note_len_chars from u join x using (note_id) where split = 'test' order by note_id limit 1 offset 3", "u", sql.splits("x", "(select note_id from u)")))
def point_lookup(spark, d):
    test = split_join(spark, d).where("split = 'test'")
    return io.note_at(test, 3).select("note_id", "note_len_chars")


@query(sql.query("select note_id, next as control_id from x", "u", sql.successor("x", "u", "note_id", "note_id")))
def derange(spark, d):
    ids = distinct_notes(spark, d).select("note_id", F.col("note_id").alias("control_id"))
    return order.successors(ids, "note_id", ["control_id"], dataset.SEED).select("note_id", F.col("next_control_id").alias("control_id"))


@query(sql.query(
    "select note_id, clinical_note, length(clinical_note) as note_len_chars, conversation, length(conversation) as conversation_len_chars, len(turns) as num_turns,"
    " len(list_filter(turns, lambda x: x like 'Doctor:%')) as num_doctor_turns, len(list_filter(turns, lambda x: x like 'Patient:%')) as num_patient_turns, false as preamble_stripped"
    " from (select 'note-' || substring(sha256(clinical_note), 1, 16) as note_id, clinical_note, conversation, turns, row_number() over (partition by clinical_note order by note_id) as k from p) where k = 1", "p"))  # fmt: skip
def dataset_records(spark, d):
    """The whole first stage over pairs: deduplicate, strip, count."""
    rows = pairs(spark, d).select(F.col("clinical_note").alias("data"), "conversation", F.col("note_id").alias("ord"))
    return dataset.records(rows, "ord")


# Numbers.


@query(rf"select doc_id, len(x)::bigint as n_numbers, coalesce(round(list_sum(x), 6), 0.0) as total from (select doc_id, {sql.numbers('text')} as x from documents)")
def extract_numbers(spark, d):
    rows = table(spark, d, "documents").select("doc_id", numbers.numbers(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n_numbers"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _with_successor(spark, d):
    """doc_id, text and the text of the next document in hash order."""
    return order.successors(table(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"], dataset.SEED)


_NEXT = sql.successor("x", "documents", "doc_id", "text")


@query(sql.query("select id as doc_id, round(recall, 6) as numeric_grounding_recall, round(prec, 6) as numeric_precision, round(1 - prec, 6) as fabricated_number_rate, n_note::bigint as n_note_numbers, n_gen::bigint as n_generated_numbers from f", _NEXT, "y as (select doc_id as id, text as note, next as gen from x)", sql.faithful("f", "y")))
def numeric_faithfulness(spark, d):
    rows = _with_successor(spark, d).select("doc_id", numbers.numbers(F.col("text")).alias("n"), numbers.numbers(F.col("next_text")).alias("g"))
    return rows.select("doc_id", *[(F.round(v, 6) if not k.startswith("n_") else v).alias(k) for k, v in numbers.faithfulness(F.col("n"), F.col("g")).items()])


@query(sql.query(f"select doc_id, len(i)::bigint as n_invented, list_max(i) as max_invented from (select doc_id, list_filter({sql.numbers('next')}, lambda v: not list_contains({sql.numbers('text')}, v)) as i from x)", _NEXT))
def invented_numbers(spark, d):
    i = numbers.invented(numbers.numbers(F.col("text")), numbers.numbers(F.col("next_text")))
    return _with_successor(spark, d).select("doc_id", i.alias("i")).select("doc_id", F.size("i").cast("long").alias("n_invented"), F.array_max("i").alias("max_invented"))


# Leaks.

# The patterns of turnloom/functions/leak.py in the dialect of the SQL.
_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_LEAK_SQL = {
    "header": r"(?m)^\s*data\s*,\s*conversation\s*$",
    "ssn": rf"{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}{_END}",
    "mrn": rf"(?i){_EDGE}(?:MRN|medical\s+record\s+(?:number|no\.?))\s*[:#]?\s*\d{{5,}}",
    "nhs": rf"{_EDGE}\d{{3}}[ -]\d{{3}}[ -]\d{{4}}{_END}",
    "dob": rf"(?i){_EDGE}(?:DOB|date\s+of\s+birth)\s*[:#]?\s*\d",
    "email": rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_END}",
}


def _reasons_sql(x: str) -> str:
    tests = ", ".join(f"case when regexp_matches({x}, '{p}') then '{k}' end" for k, p in _LEAK_SQL.items())
    return f"concat_ws(',', {tests})"


_SCREENED = f"select 'doc-' || doc_id as id, {_reasons_sql('text')} as reasons from documents union all select 'page-' || page_id, {_reasons_sql('html')} from pages"


@query(_SCREENED)
def leak_patterns(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("id"), F.col("html").alias("text"))
    return docs.union(pages).select("id", F.array_join(leak.content_reasons(F.col("text")), ",").alias("reasons"))


@query(f"select count(*) as n_files, count(*) filter (reasons <> '') as n_blocked, count(*) filter (reasons <> '') > 0 as blocked from ({_SCREENED})")
def leak_gate(spark, d):
    hit = F.count_if(F.col("reasons") != "")
    return leak_patterns(spark, d).agg(F.count("*").alias("n_files"), hit.alias("n_blocked"), (hit > 0).alias("blocked"))


# The pages as files of a work tree: folder and suffix by page number, the rest from the url.
_FOLDERS = ["data", "src/data", "annotation/gold_v1", "docs/golden", "models", "artifacts/eval", "notes", "artifacts/evals"]
_SUFFIXES = ["", ".csv", ".md", ".PARQUET", ".jsonl"]
_URL_PATH = "^[a-z]+://[^/]*/([^?#]*)"
_STAGED = f"(select page_id, ({_FOLDERS})[1 + page_id % {len(_FOLDERS)}] || '/' || regexp_extract(url, '{_URL_PATH}', 1) || ({_SUFFIXES})[1 + page_id % {len(_SUFFIXES)}] as path, html from pages)"
_PATH_TESTS = (
    "case when string_split(path, '/')[1] in ('data', 'models', 'outputs') then 'folder' end,"
    " case when len(list_filter(string_split(path, '/')[:-2], lambda x: x like 'gold%')) > 0 then 'gold' end,"
    r" case when lower(regexp_extract(string_split(path, '/')[-1], '.(\.[^.]+)$', 1)) in ('.parquet', '.csv', '.jsonl') then 'suffix' end"
)


def _staged(spark, d):
    """page_id, path and html of the pages."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int"))
    path = F.concat(pick(_FOLDERS), F.lit("/"), F.regexp_extract("url", _URL_PATH, 1), pick(_SUFFIXES))
    return table(spark, d, "pages").select("page_id", path.alias("path"), "html")


@query(f"select page_id, path, concat_ws(',', {_PATH_TESTS}) as reasons from {_STAGED}")
def leak_paths(spark, d):
    return _staged(spark, d).select("page_id", "path", F.array_join(leak.path_reasons(F.col("path")), ",").alias("reasons"))


@query(
    f"select page_id, path, concat_ws(',', {_PATH_TESTS}, case when not starts_with(path, 'artifacts/eval/') then nullif(own, '') end) as reasons"
    f" from (select *, {_reasons_sql('html')} as own from {_STAGED})"
)
def leak_allowlist(spark, d):
    return _staged(spark, d).select("page_id", "path", F.array_join(leak.reasons(F.col("path"), F.col("html")), ",").alias("reasons"))


# Overlap scores.

_TOLD = sql.successor("x", "b", "conv_id", "conversation")
_PAIRED = "y as (select conv_id as id, conversation as ref, next as gen from x)"


def _dialogue_pairs(spark, d):
    return order.successors(stripped(spark, d).select("conv_id", "conversation"), "conv_id", ["conversation"], dataset.SEED)


def _rouge_query(m: str):
    s = {"rouge1": "r1", "rouge2": "r2", "rougeL": "rl"}[m]

    @query(sql.query(f"select id as conv_id, round({s}_p, 6) as p, round({s}_r, 6) as r, round({s}_f, 6) as f from z", "b", _TOLD, _PAIRED, sql.rouge("z", "y")), f"{m.lower()}_raw")
    def one(spark, d):
        rows = _dialogue_pairs(spark, d).select("conv_id", rouge(F.col("conversation"), F.col("next_conversation"), stemmed=False).alias("s"))
        return rows.select("conv_id", *[F.round(f"s.{m}_{x}", 6).alias(x) for x in "prf"])


for _m in ("rouge1", "rouge2", "rougeL"):
    _rouge_query(_m)


@query(sql.query("select id as conv_id, round(r1_f, 6) as rouge1, round(r2_f, 6) as rouge2, round(rl_f, 6) as \"rougeL\" from z", "b", _TOLD, _PAIRED, sql.stemmed("ys", "y"), sql.rouge("z", "ys")))
def rouge_stemmed(spark, d):
    rows = _dialogue_pairs(spark, d).select("conv_id", rouge(F.col("conversation"), F.col("next_conversation")).alias("s"))
    return rows.select("conv_id", *[F.round(f"s.{m}_f", 6).alias(m) for m in ("rouge1", "rouge2", "rougeL")])


# Retrieval.

_SETS = sql.splits("x", "(select note_id, text from u)") + ",\ntr as (select note_id, text from x where split = 'train'),\nte as (select note_id, text from x where split = 'test')"


def _sets(spark, d):
    found = dataset.split_texts(table(spark, d, "documents"), "text", "doc_id")
    return [found[s] for s in ("train", "test")]


@query(sql.query("select term, tf, df, round(idf, 6) as idf from m_vocab", "u", _SETS, sql.tfidf("m", "tr", "te")))
def tfidf_vocab(spark, d):
    train, _ = _sets(spark, d)
    n = train.agg(F.count("*").cast("double").alias("n"))
    return retrieval.with_idf(retrieval.vocabulary(train).crossJoin(F.broadcast(n)), F.col("n")).select("term", "tf", "df", F.round("idf", 6).alias("idf"))


@query(sql.query("select note_id, term, round(w, 6) as w from m_qw", "u", _SETS, sql.tfidf("m", "tr", "te")))
def tfidf_weights(spark, d):
    train, test = _sets(spark, d)
    n = train.agg(F.count("*").cast("double").alias("n"))
    vocab = retrieval.with_idf(retrieval.vocabulary(train).crossJoin(F.broadcast(n)), F.col("n"))
    return retrieval.weights(test, vocab).select("note_id", "term", F.round("w", 6).alias("w"))


@query(sql.query("select query_id as note_id, note_id as retrieved_note_id, round(similarity, 6) as similarity from m_top", "u", _SETS, sql.tfidf("m", "tr", "te"), sql.top("m", "tr", "te", 1)))
def retrieve_top1(spark, d):
    train, test = _sets(spark, d)
    top = retrieval.Retriever().fit(train).top(test)
    return top.select(F.col("query_id").alias("note_id"), F.col("note_id").alias("retrieved_note_id"), F.round("similarity", 6).alias("similarity"))


@query(sql.query("select query_id as note_id, note_id as retrieved_note_id, round(similarity, 6) as similarity, rank::int as rank from m_top", "u", _SETS, sql.tfidf("m", "tr", "te"), sql.top("m", "tr", "te", 5)))
def retrieve_topk(spark, d):
    train, test = _sets(spark, d)
    top = retrieval.Retriever().fit(train).top(test, 5)
    return top.select(F.col("query_id").alias("note_id"), F.col("note_id").alias("retrieved_note_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


# Statistics.

_VALUES = "v as (select event_id, \"value\" from events where \"value\" is not null)"


def _values(spark, d):
    return table(spark, d, "events").select("event_id", "value").where("value is not null")


@query(sql.query("select * from bs_rows", _VALUES, sql.bootstrap("v", ["value"], "event_id")))
def bootstrap_ci(spark, d):
    return stats.bootstrap(_values(spark, d), "event_id", ["value"])


_TWO = "v2 as (select event_id, \"value\" - \"value\" * 0.9 - 1 as \"value\" from v)"


def _two(spark, d):
    a = _values(spark, d)
    return a, a.select("event_id", (F.col("value") * 0.9 + 1).alias("value"))


@query(sql.query("select *, ci_low > 0 or ci_high < 0 as excludes_zero from bs_rows", _VALUES, _TWO.replace(" - 1", " - 1.0"), sql.bootstrap("v2", ["value"], "event_id", point="delta")))
def paired_delta(spark, d):
    a, b = _two(spark, d)
    return stats.paired_deltas(a, b, "event_id", ["value"])


@query(sql.query("select metric, ci_low > 0 or ci_high < 0 as excludes_zero from bs_rows", _VALUES, _TWO.replace(" - 1", " - 1.0"), sql.bootstrap("v2", ["value"], "event_id", point="delta")))
def excludes_zero(spark, d):
    return paired_delta(spark, d).select("metric", "excludes_zero")


# Arms.

_ARMS = sorted(arms.ARMS)


def _arm_sql(*stems: str) -> str:
    """Scores (sc) of all arms; stems: CTEs that make ys of y, which is scored then."""
    return (
        sql.successor("sx", "p", "note_id", "conversation")
        + ","
        + sql.splits("ax", "(select note_id from p)")
        + ",\natr as (select note_id, clinical_note as text from p join ax using (note_id) where split = 'train'),\nate as (select note_id, clinical_note as text from p),"
        + sql.tfidf("a", "atr", "ate")
        + ","
        + sql.top("a", "atr", "ate", 1)
        + """,
made as (
  select 'self' as arm, note_id, clinical_note, conversation, conversation as gen from p
  union all select 'half', note_id, clinical_note, conversation, array_to_string(turns[1:(len(turns) + 1) // 2], chr(10)) from p
  union all select 'successor', p.note_id, p.clinical_note, p.conversation, sx.next from p join sx using (note_id)
  union all select 'retrieval', p.note_id, p.clinical_note, p.conversation, q.conversation from p join a_top on a_top.query_id = p.note_id join p q on q.note_id = a_top.note_id),
y as (select arm || '/' || note_id as id, conversation as ref, gen from made),
yn as (select arm || '/' || note_id as id, clinical_note as note, gen from made),"""
        + "".join(f"{s}," for s in stems)
        + sql.rouge("z", "ys" if stems else "y")
        + ","
        + sql.faithful("f", "yn")
        + f""",
sc as (select arm, note_id, r1_f as rouge1, r2_f as rouge2, rl_f as rougeL, recall as numeric_grounding_recall, prec as numeric_precision, 1 - prec as fabricated_number_rate,
  {sql.flags("gen")} from made join z on z.id = arm || '/' || note_id join f on f.id = z.id)"""
    )


_ARM_SQL = _arm_sql()
_STEMMED_SQL = _arm_sql(sql.stemmed("ys", "y"))


def _wide_sql(metrics: list[str]) -> str:
    return "wd as (select note_id, " + ", ".join(f"max(case when arm = '{a}' then {m} end) as \"{a}|{m}\"" for a in _ARMS for m in metrics) + " from sc group by note_id)"


def _told(spark, d):
    return io.written(pairs(spark, d), "told")  # read some twenty times


def _scores(spark, d, stemmed=False):
    return arms.run(_told(spark, d), stemmed=stemmed)


@query(sql.query("select arm, note_id, " + ", ".join(f"round({m}, 6) as {m}" for m in arms.METRICS) + ", starts_with_turn_marker, num_turns, has_doctor_turn, has_patient_turn from sc", "p", _ARM_SQL))
def arm_scores(spark, d):
    flags = ("starts_with_turn_marker", "num_turns", "has_doctor_turn", "has_patient_turn")
    return _scores(spark, d).select("arm", "note_id", *_six(*arms.METRICS), *flags)


@query(sql.query("select split_part(metric, '|', 1) as arm, split_part(metric, '|', 2) as metric, point_estimate, ci_low, ci_high, n, n_resamples from bs_rows", "p", _STEMMED_SQL, _wide_sql(arms.METRICS), sql.bootstrap("wd", [f"{a}|{m}" for a in _ARMS for m in arms.METRICS])))
def arm_aggregate(spark, d):
    return arms.aggregate(_scores(spark, d, stemmed=True).cache(), _ARMS)


@query()
def arm_bertscore(spark, d):
    """Without SQL: DuckDB lacks the encoder's hash; a test compares with a plain form."""
    return arms.run(_told(spark, d), stemmed=False, encode=embedscore.hashed).select("arm", "note_id", *_six(arms.EMBEDDED))


_NEAR_WORDS = 2000
_PMI = f"""
wt as (select note_id, w[i] as word, i from (select note_id, w, unnest(range(1, len(w) + 1)) as i from (select conv_id as note_id, regexp_extract_all(lower(conversation), '[\\p{{L}}\\p{{N}}_]+') as w from b))),
wv as (select word, row_number() over (order by count(*) desc, word) as k from wt group by word qualify k <= {_NEAR_WORDS}),
wp as (select a.word as a, b.word as b, count(*) as n from wt a join wt b on a.note_id = b.note_id and b.i between a.i - {wordvectors.WINDOW} and a.i + {wordvectors.WINDOW} and a.i <> b.i
  where a.word in (select word from wv) and b.word in (select word from wv) group by 1, 2),
ws as (select a as word, sum(n)::double as c from wp group by 1),
wm as (select a, b, n, ln(n / t / (x.c / t) / (y.c ** {wordvectors.SMOOTHING} / s)) as pmi
  from wp join ws x on x.word = a join ws y on y.word = b, (select sum(c) as t, sum(c ** {wordvectors.SMOOTHING}) as s from ws))"""


@query(sql.query("select a as word, b as near, n::bigint as n, round(pmi, 6) as pmi from wm where pmi > 0", "b", _PMI))
def word_information(spark, d):
    """Words of the dialogues that stand near each other more often than by chance."""
    texts = stripped(spark, d).select(F.col("conversation").alias("text"))
    known = wordvectors.words(texts, _NEAR_WORDS)
    names = spark.createDataFrame(list(enumerate(known)), "i int, word string")  # _NEAR_WORDS rows at most
    rows = wordvectors.information(wordvectors.near(texts, known)).join(F.broadcast(names), "i").join(F.broadcast(names.toDF("j", "near")), "j")
    return rows.select("word", "near", "n", F.round("pmi", 6).alias("pmi"))


@query()
def arm_bertscore_learned(spark, d):
    """Without SQL: vectors come from a decomposition; tests compare it with a whole one and score planted paraphrases."""
    rows = _told(spark, d)
    ids = dataset.split(rows.select("note_id")).where("split = 'train'").select("note_id")
    train = rows.join(ids, "note_id", "left_semi")
    encode = wordvectors.fit(train.select(F.col("clinical_note").alias("text")).union(train.select("conversation"))).encoder(spark)
    return arms.run(rows, stemmed=False, encode=encode).select("arm", "note_id", *_six(arms.EMBEDDED))


@query(sql.query("select arm, round(avg((starts_with_turn_marker and has_doctor_turn and has_patient_turn)::int), 6) as turn_format_valid_rate from sc group by arm", "p", _ARM_SQL))
def arm_valid_rate(spark, d):
    return arms.valid_rate(_scores(spark, d))


@query(sql.query(
    "select arm, (select count(*) from (select note_id from sc where sc.arm = a.arm except select note_id from sc where sc.arm = 'half')) as only_here,"
    " (select count(*) from (select note_id from sc where sc.arm = 'half' except select note_id from sc where sc.arm = a.arm)) as only_there from (select distinct arm from sc) a", "p", _ARM_SQL))  # fmt: skip
def comparable_check(spark, d):
    return compare.comparable(_scores(spark, d).select("arm", "note_id"), _ARMS)


_PAIRS = [(a, b, m) for i, a in enumerate(_ARMS) for b in _ARMS[i + 1 :] for m in sorted(arms.COMPARED)]


@query(sql.query(
    "select split_part(metric, '|', 1) as arm_a, split_part(metric, '|', 2) as arm_b, split_part(metric, '|', 3) as metric, delta, ci_low, ci_high, n, n_resamples, ci_low > 0 or ci_high < 0 as excludes_zero from bs_rows",
    "p", _ARM_SQL, _wide_sql(arms.COMPARED),
    "df as (select note_id, " + ", ".join(f'"{a}|{m}" - "{b}|{m}" as "{a}|{b}|{m}"' for a, b, m in _PAIRS) + " from wd)",
    sql.bootstrap("df", [f"{a}|{b}|{m}" for a, b, m in _PAIRS], point="delta")))
def compare_arms(spark, d):
    return compare.compare(_scores(spark, d).cache(), _ARMS)


@query(sql.query("select a.arm as arm_a, b.arm as arm_b, note_id, round(a.rouge1 - b.rouge1, 6) as rouge1_delta from sc a join sc b using (note_id) where a.arm < b.arm", "p", _ARM_SQL))
def all_pairs(spark, d):
    rows = _scores(spark, d).select("arm", "note_id", "rouge1")
    each = rows.groupBy("note_id").agg(F.collect_list(F.struct("arm", "rouge1")).alias("s"))  # a row for each arm, made once
    left = each.select("note_id", "s", F.inline("s")).toDF("note_id", "s", "arm_a", "x")
    both = left.select("note_id", "arm_a", "x", F.inline("s")).toDF("note_id", "arm_a", "x", "arm_b", "y")
    return both.where("arm_a < arm_b").select("arm_a", "arm_b", "note_id", F.round(F.col("x") - F.col("y"), 6).alias("rouge1_delta"))


# Memorisation.

_PROBE = (
    f"hs as (select lpad(conv_id::varchar, 12, '0') as note_id, array_to_string(turns[1:len(turns) // 2], chr(10)) as prefix, array_to_string(turns[len(turns) // 2 + 1:], chr(10)) as continuation from b where len(turns) >= 4),"
    + sql.successor("cx", "hs", "note_id", "continuation")
    + """,
yt as (select note_id as id, continuation as ref, prefix as gen from hs),
yc as (select note_id as id, next as ref, prefix as gen from cx join hs using (note_id)),"""
    + sql.rouge("zt", "yt")
    + ","
    + sql.rouge("zc", "yc")
    + ',\npr as (select id as note_id, zt.rl_f as "rougeL_vs_true", zc.rl_f as "rougeL_vs_control", zt.rl_f - zc.rl_f as delta from zt join zc using (id)),'
    + sql.bootstrap("pr", ["rougeL_vs_true", "rougeL_vs_control", "delta"], point="estimate")
)


def _probe(spark, d):
    rows = stripped(spark, d).select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("note_id"), "conversation")
    return contamination.probe(rows, n=None, stemmed=False)


@query(sql.query("select *, ci_low > 0 or ci_high < 0 as excludes_zero from bs_rows", "b", _PROBE))
def contamination_delta(spark, d):
    return contamination.delta(_probe(spark, d))


@query(sql.query(
    "select delta, case when control <> 0 then round(delta / control, 6) end as relative_lift, case when not sure or delta <= 0 then 'not detected' when delta < 0.05 then 'detectable but small' else 'substantial' end as verdict"
    " from (select max(case when metric = 'delta' then estimate end) as delta, bool_or(metric = 'delta' and (ci_low > 0 or ci_high < 0)) as sure, max(case when metric = 'rougeL_vs_control' then estimate end) as control from bs_rows)", "b", _PROBE))  # fmt: skip
def contamination_verdict(spark, d):
    return contamination.verdict(contamination_delta(spark, d))


_W = continuation.WORD
_HEART = (
    "hs as (select lpad(conv_id::varchar, 12, '0') as note_id, array_to_string(turns[1:len(turns) // 2], chr(10)) as prefix, array_to_string(turns[len(turns) // 2 + 1:], chr(10)) as continuation from b where len(turns) >= 4),"
    "\nnb as (select lpad(conv_id::varchar, 12, '0') as note_id, conversation from b),"
    + sql.splits("nx", "nb")
    + f""",
ct as (select note_id, regexp_extract_all(conversation, '{_W}') as w from nx where split = 'train'),
cg as (select note_id, p, m, array_to_string(w[p - m + 1:p], ' ') as g from (select *, unnest(range({continuation.LEAST}, least({continuation.DEPTH}, p) + 1)) as m from (select *, unnest(range({continuation.LEAST}, len(w))) as p from ct))),
qt as (select note_id as id, regexp_extract_all(prefix, '{_W}') as w from hs),
qg as (select id, m, array_to_string(w[len(w) - m + 1:], ' ') as g from (select *, unnest(range({continuation.LEAST}, least({continuation.DEPTH}, len(w)) + 1)) as m from qt)),
hit as (select id, m, note_id, p from (select *, row_number() over (partition by id order by m desc, note_id, p) as k from qg join cg using (m, g)) where k = 1),
ht as (select q.id as note_id, coalesce(m, 0) as n_shared, coalesce(array_to_string(c.w[p + 1:p + {continuation.NEW_WORDS}], ' '), '') as generated from qt q left join hit on hit.id = q.id left join ct c on c.note_id = hit.note_id)"""
)


def _by_heart(spark, d):
    """All dialogues, and those of the training split as a corpus."""
    rows = stripped(spark, d).select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("note_id"), "conversation")
    ids = dataset.split(rows.select("note_id")).where("split = 'train'").select("note_id")
    return rows, rows.join(ids, "note_id", "left_semi").select("note_id", F.col("conversation").alias("text"))


@query(sql.query("select note_id, n_shared, generated from ht", "b", _HEART))
def corpus_continuation(spark, d):
    """The first half of each dialogue, continued by what follows its longest end in the training split."""
    rows, corpus = _by_heart(spark, d)
    texts = contamination.cut(rows).select(F.col("note_id").alias("id"), F.col("prefix").alias("text"))
    return continuation.continued(texts, corpus).withColumnRenamed("id", "note_id")


_HEART_PROBE = (
    sql.successor("cx", "hs", "note_id", "continuation")
    + """,
yt as (select note_id as id, continuation as ref, generated as gen from hs join ht using (note_id)),
yc as (select note_id as id, next as ref, generated as gen from cx join ht using (note_id)),"""
    + sql.rouge("zt", "yt")
    + ","
    + sql.rouge("zc", "yc")
    + ',\npr as (select id as note_id, zt.rl_f as "rougeL_vs_true", zc.rl_f as "rougeL_vs_control", zt.rl_f - zc.rl_f as delta from zt join zc using (id)),'
    + sql.bootstrap("pr", ["rougeL_vs_true", "rougeL_vs_control", "delta"], point="estimate")
)


@query(sql.query("select *, ci_low > 0 or ci_high < 0 as excludes_zero from bs_rows", "b", _HEART, _HEART_PROBE))
def memory_delta(spark, d):
    """The memorisation probe of a model that knows the training split by heart."""
    rows, corpus = _by_heart(spark, d)
    return contamination.delta(contamination.probe(rows, n=None, stemmed=False, continue_all=contamination.from_corpus(corpus)))


# Training texts.


@query(sql.query(f"select note_id, {sql.PROMPT} || clinical_note as prompt from p", "p"))
def user_prompt(spark, d):
    return pairs(spark, d).select("note_id", text.user_prompt(F.col("clinical_note")).alias("prompt"))


_SAID = f"[['system', '{text.SYSTEM_PROMPT}'], ['user', {sql.PROMPT} || clinical_note], ['assistant', conversation]]"


@query(sql.query(f"select note_id, i - 1 as idx, m[1] as role, m[2] as content from (select note_id, unnest(l) as m, generate_subscripts(l, 1) as i from (select note_id, {_SAID} as l from p))", "p"))
def chat_messages(spark, d):
    rows = pairs(spark, d).select("note_id", F.posexplode(text.chat_messages(F.col("clinical_note"), F.col("conversation"))).alias("idx", "m"))
    return rows.select("note_id", F.col("idx").cast("long").alias("idx"), "m.role", "m.content")


@query(sql.query(f"select note_id, array_to_string(list_transform({_SAID}, lambda m: '<|im_start|>' || m[1] || chr(10) || m[2] || '<|im_end|>' || chr(10)), '') as text from p", "p"))
def chat_text(spark, d):
    return pairs(spark, d).select("note_id", text.chat_text(text.chat_messages(F.col("clinical_note"), F.col("conversation"))).alias("text"))


#: Ranked byte-pair tokens, outside the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def token_counts(spark, d):
    """Without SQL: byte pairs are merged in ranked order; tests compare with a plain loop and a public encoder."""
    return chat_text(spark, d).select("note_id", packing.Tokenizer.of_chat(spark, TOKENIZER).count(F.col("text")).alias("n_tokens"))


@query()
def packed_rows(spark, d):
    """Where each training text stands in sequences of packing.CAPACITY tokens.  Without SQL: tests compare with best fit text by text."""
    return packing.pack(token_counts(spark, d))


@query()
def packed_fill(spark, d):
    return packing.fill(packed_rows(spark, d))


@query(f"select doc_id, case when length(text) > {text.SHOWN} then substring(text, 1, {text.SHOWN}) || chr(10) || '[first {text.SHOWN} characters]' else text end as shown from documents")
def display_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shown(F.col("text")).alias("shown"))


@query(
    """with e as (select label, vec_id, embedding::double[] as v from embeddings),
c as (select a.label as label_a, b.label as label_b, a.vec_id as i, b.vec_id as j, list_cosine_similarity(a.v, b.v) as s from e a join e b on a.label < b.label),
pp as (select label_a, label_b, avg(m) as p from (select label_a, label_b, i, max(s) as m from c group by 1, 2, 3) group by 1, 2),
rr as (select label_a, label_b, avg(m) as r from (select label_a, label_b, j, max(s) as m from c group by 1, 2, 3) group by 1, 2)
select label_a, label_b, round(p, 6) as p, round(r, 6) as r, round(2 * p * r / (p + r), 6) as f1 from pp join rr using (label_a, label_b)"""
)
def embed_score(spark, d):
    """Stand-in texts: the tokens of one are the vectors of a label; every pair of labels is scored."""
    vecs = table(spark, d, "embeddings").select(F.col("label").alias("id"), F.col("embedding").alias("vec"))
    labels = vecs.select("id").distinct()
    wanted = labels.toDF("gen_id").join(labels.toDF("ref_id"), F.expr("gen_id < ref_id"))
    return embedscore.embed_score(vecs, vecs, wanted).withColumnsRenamed({"gen_id": "label_a", "ref_id": "label_b"})


# Sources and sinks: what is written is read again.


@query(sql.query("select split, count(*) as n from x group by split", "u", sql.splits("x", "(select note_id from u)")))
def parquet_roundtrip(spark, d):
    path = io.scratch(spark, "splits")
    io.write_splits(split_assign(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query(sql.query("select count(*) as n, sum(length(clinical_note))::bigint as note_chars, sum(length(conversation))::bigint as conversation_chars from p", "p"))
def csv_roundtrip(spark, d):
    path = io.scratch(spark, "pairs")
    io.write_pairs_csv(pairs(spark, d).select(F.col("clinical_note").alias("data"), "conversation"), path)
    back = io.read_pairs_csv(spark, path)
    return back.agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("note_chars"), F.sum(F.length("conversation")).alias("conversation_chars"))


@query(sql.query("select arm, count(*) as n_records, round(avg(rouge1), 6) as rouge1 from sc group by arm", "p", _ARM_SQL))
def arm_json_roundtrip(spark, d):
    path = io.scratch(spark, "arms")
    io.write_arms(_scores(spark, d), path, {"decoding": F.struct(F.lit(False).alias("do_sample"))})
    return io.read_arms(spark, f"{path}/*/*.txt").groupBy("arm").agg(F.count("*").alias("n_records"), F.round(F.avg("rouge1"), 6).alias("rouge1"))
