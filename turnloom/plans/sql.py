"""Common table expressions of the SQL that queries are checked against (DuckDB dialect)."""

from __future__ import annotations

import re

from turnloom.functions import text
from turnloom.functions.porter import STEP_2, STEP_3, STEP_4
from turnloom.operators import stats
from turnloom.operators.retrieval import MAX_FEATURES, STOP_WORDS

_NUMBERS = r"list_distinct(list_transform(regexp_extract_all({0}, '\d+(?:\.\d+)?'), lambda x: x::double))"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def numbers(x: str) -> str:
    return _NUMBERS.format(x)


def trim(x: str) -> str:
    return _TRIM.format(x)


def md5_order(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key}::varchar), {key}"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def terms(x: str) -> str:
    words = rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: not list_contains({_STOP}, w))"
    return f"(select case when len(w) < 2 then w else w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end from (select {words} as w))"


def tfidf(name: str, train: str, queries: str) -> str:
    """CTEs name_vocab, name_tw and name_qw (note_id, term, w) of train and queries, which are (note_id, text)."""
    weigh = "select note_id, term, (1 + ln(c)) * idf / sqrt(sum(((1 + ln(c)) * idf) ** 2) over (partition by note_id)) as w from {0} join {1}_vocab using (term)"
    count = "select note_id, term, count(*) as c from (select note_id, unnest({0}) as term from {1}) group by 1, 2"
    return f"""
{name}_tt as ({count.format(terms("text"), train)}),
{name}_qt as ({count.format(terms("text"), queries)}),
{name}_vocab as (select term, tf, df, ln((1.0 + (select count(*) from {train})) / (1.0 + df)) + 1.0 as idf from
  (select term, sum(c)::bigint as tf, count(*) as df from {name}_tt group by 1 order by 2 desc, 1 limit {MAX_FEATURES})),
{name}_tw as ({weigh.format(name + "_tt", name)}),
{name}_qw as ({weigh.format(name + "_qt", name)})"""


def top(name: str, train: str, queries: str, k: int) -> str:
    """CTE name_top (query_id, note_id, similarity, rank)."""
    return f"""
{name}_sim as (select q.note_id as query_id, t.note_id, round(sum(q.w * t.w), 9) as s from {name}_qw q join {name}_tw t using (term) group by 1, 2),
{name}_all as (select q.note_id as query_id, t.note_id, coalesce(s, 0.0) as similarity from {queries} q cross join {train} t
  left join {name}_sim x on x.query_id = q.note_id and x.note_id = t.note_id),
{name}_top as (select * from (select *, row_number() over (partition by query_id order by similarity desc, note_id) as rank from {name}_all) where rank <= {k})"""


def _draw(stage: int, seed: int, b: str, x: str, y: str) -> str:
    """Columns of a select, the last one `draw`: stats.draws() of the three expressions, each step a column that the next ones use."""
    out, words = [], []
    for word, start in enumerate(stats.starts(seed, stage)):
        last = f"xor({start}::bigint, {b})"
        for i, more in enumerate((x, y, None)):
            v = f"w{word}{i}"
            out += [f"{last} as {v}a", f"(xor({v}a, {v}a >> {stats.SHIFTS[0]}) * {stats.FACTORS[0]}) & {stats.WORD} as {v}b"]
            out += [f"(xor({v}b, {v}b >> {stats.SHIFTS[1]}) * {stats.FACTORS[1]}) & {stats.WORD} as {v}c", f"xor({v}c, {v}c >> {stats.SHIFTS[2]}) as {v}d"]
            last = f"({v}d + {more}) & {stats.WORD}"
        words.append(f"{v}d")
    return ", ".join([*out, f"({words[0]} << 31) | {words[1]} as draw"])


def bootstrap(records: str, metrics: list[str], key: str = "note_id", resamples: int = 1000, seed: int = 42, point: str = "point_estimate") -> str:
    """Body of a query for metric, point, ci_low, ci_high, n, n_resamples of columns of the CTE `records`."""
    quoted = [f'"{m}"' for m in metrics]
    means = ", ".join(f"sum({q}) / nullif(count({q}), 0) as {q}" for q in quoted)
    rows = " union all ".join(
        f"select '{m}' as metric, (select round(avg({q}), 6) from {records}) as {point}, round(quantile_cont({q}, 0.025), 6) as ci_low, round(quantile_cont({q}, 0.975), 6) as ci_high from bs_means"
        for m, q in zip(metrics, quoted)
    )
    return f"""
bs_n as (select count(*) as n from {records}),
bs_pos as (select {", ".join(quoted)}, row_number() over (order by {md5_order(seed, key)}) - 1 as pos from {records}),
bs_falls as (select b, draw % n // {stats.BLOCK} as block, n from (
  select b, n, {_draw(0, seed, "b", f"(x & {stats.WORD})", "(x >> 31)")} from (select b, n, unnest(range(n)) as x from range({resamples}) r(b), bs_n where n > {stats.BLOCK}))),
bs_counts as (select b, block, n, count(*) as c from bs_falls group by all union all select b, 0, n, n from range({resamples}) r(b), bs_n where n <= {stats.BLOCK}),
bs_picks as (select b, block * {stats.BLOCK} + draw % least({stats.BLOCK}, n - block * {stats.BLOCK}) as pos from (
  select b, block, n, {_draw(1, seed, "b", "block", "x")} from (select b, block, n, unnest(range(c)) as x from bs_counts))),
bs_means as (select b, {means} from bs_picks join bs_pos using (pos) group by b),
bs_rows as (select *, (select n from bs_n) as n, {resamples}::bigint as n_resamples from ({rows}))"""


def rouge(name: str, pairs: str) -> str:
    """CTE name(id, r1_p .. r2_f, lcs, rl_p, rl_r, rl_f) of the CTE pairs(id, ref, gen)."""

    def grams(n: int) -> str:
        gram = "t[i]" if n == 1 else "t[i] || ' ' || t[i + 1]"
        return f"""
{name}_c{n} as (select id, side, g, count(*) as c from (select id, side, unnest(list_transform(range(1, len(t) + 2 - {n}), lambda i: {gram})) as g from {name}_s) group by 1, 2, 3),
{name}_o{n} as (select id, (sum(least(coalesce(a.c, 0), coalesce(b.c, 0))))::double as hit, sum(coalesce(a.c, 0))::double as na, sum(coalesce(b.c, 0))::double as nb
  from (select * from {name}_c{n} where side = 'r') a full join (select * from {name}_c{n} where side = 'g') b using (id, g) group by 1)"""

    def prf(hit: str, nb: str, na: str, m: str) -> str:
        ok = f"coalesce({hit}, 0) > 0"
        p, r = f"({hit} / {nb})", f"({hit} / {na})"
        return ", ".join(f"case when {ok} then {v} else 0.0 end as {m}_{x}" for x, v in (("p", p), ("r", r), ("f", f"2 * {p} * {r} / ({p} + {r})")))

    return f"""
{name}_t as (select id, {tokens("ref")} as a, {tokens("gen")} as b from {pairs}),
{name}_s as (select id, 'r' as side, a as t from {name}_t union all select id, 'g', b from {name}_t),{grams(1)},{grams(2)},
{name}_l as (
  select id, a, b, 0 as i, list_transform(range(len(b) + 1), lambda x: 0::bigint) as row from {name}_t
  union all
  select id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(spots, lambda k: k < j), lambda k: row[k] + 1)), 0)))
  from (select *, list_filter(range(1, len(b) + 1), lambda k: b[k] = a[i + 1]) as spots from {name}_l where i < len(a))),
{name} as (select t.id, {prf("o1.hit", "o1.nb", "o1.na", "r1")}, {prf("o2.hit", "o2.nb", "o2.na", "r2")}, l.row[len(l.row)] as lcs,
  {prf("l.row[len(l.row)]", "len(t.b)", "len(t.a)", "rl")}
  from {name}_t t left join {name}_o1 o1 on o1.id = t.id left join {name}_o2 o2 on o2.id = t.id join {name}_l l on l.id = t.id and l.i = len(l.a))"""


# Word shapes for porter(): a run of consonants, a run of vowels; a y that opens a word is written Y before.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _measured(x: str, more_than: int) -> str:
    return f"regexp_matches({x}, '^({_C})?{(_V + _C) * (more_than + 1)}')"


def _short(x: str) -> str:
    return f"regexp_matches({x}, '^{_C}[aeiouy][^aeiouwxy]$')"


def porter(name: str, words: str) -> str:
    """CTE name(w, stem) of the CTE words(w): lower-case words of more than three letters are stemmed."""
    vowel = f"regexp_matches({{0}}, '^({_C})?[aeiouy]')"

    def mended(x: str) -> str:
        twice = f"right({x}, 1) = left(right({x}, 2), 1) and regexp_matches({x}, '[^aeiouylsz]$') and length({x}) > 1"
        return f"case when regexp_matches({x}, '(at|bl|iz)$') then {x} || 'e' when {twice} then left({x}, -1) when {_short(x)} then {x} || 'e' else {x} end"

    def past(end: str) -> str:
        x = f"left(w1, -{len(end)})"
        return f"when w1 like '%{end}' then case when {vowel.format(x)} then {mended(x)} else w1 end"

    def cut(column: str, ends) -> str:
        both = f"'^(.*?)({'|'.join(ends)})$'"  # the longest ending
        return f"regexp_extract({column}, {both}, 1) as base, regexp_extract({column}, {both}, 2) as suffix"

    def swapped(column: str, table: dict[str, str]) -> str:
        new = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
        return f"case when suffix <> '' and {_measured('base', 0)} then base || case suffix {new} end else {column} end"

    drop = f"suffix <> '' and {_measured('base', 1)} and (suffix <> 'ion' or regexp_matches(base, '[st]$'))"
    e = "left(w6, -1)"
    final = f"w6 like '%e' and ({_measured(e, 1)} or ({_measured(e, 0)} and not {_short(e)}))"
    return f"""
{name}_1 as (select w, case when w0 like '%sses' or w0 like '%ies' then left(w0, -2) when w0 like '%s' and w0 not like '%ss' then left(w0, -1) else w0 end as w1
  from (select w, regexp_replace(w, '^y', 'Y') as w0 from {words} where length(w) > 3)),
{name}_2 as (select w, case when w1 like '%eed' then case when {_measured("left(w1, -3)", 0)} then left(w1, -1) else w1 end {past("ed")} {past("ing")} else w1 end as w2 from {name}_1),
{name}_3 as (select w, case when w2 like '%y' and {vowel.format("left(w2, -1)")} then left(w2, -1) || 'i' else w2 end as w3 from {name}_2),
{name}_4 as (select w, {swapped("w3", STEP_2)} as w4 from (select *, {cut("w3", STEP_2)} from {name}_3)),
{name}_5 as (select w, {swapped("w4", STEP_3)} as w5 from (select *, {cut("w4", STEP_3)} from {name}_4)),
{name}_6 as (select w, case when {drop} then base else w5 end as w6 from (select *, {cut("w5", STEP_4)} from {name}_5)),
{name}_7 as (select w, case when {final} then {e} else w6 end as w7 from {name}_6),
{name} as (select w, lower(case when w7 like '%ll' and {_measured("w7", 1)} then left(w7, -1) else w7 end) as stem from {name}_7
  union all select w, w from {words} where length(w) <= 3)"""


def stemmed(name: str, pairs: str) -> str:
    """CTE name(id, ref, gen) of the CTE pairs, each text as its stems with blanks between."""
    side = "select id, '{0}' as side, unnest({1}) as w, generate_subscripts({1}, 1) as i from {2}"
    text_of = f"(select string_agg(stem, ' ' order by i) from {name}_at a where a.id = p.id and side = '{{0}}')"
    return f"""
{name}_w as ({side.format("ref", tokens("ref"), pairs)} union all {side.format("gen", tokens("gen"), pairs)}),
{name}_v as (select distinct w from {name}_w),{porter(name + "_st", name + "_v")},
{name}_at as (select id, side, i, stem from {name}_w join {name}_st using (w)),
{name} as (select id, coalesce({text_of.format("ref")}, '') as ref, coalesce({text_of.format("gen")}, '') as gen from {pairs} p)"""


def faithful(name: str, pairs: str) -> str:
    """CTE name(id, recall, precision, fabricated, n_note, n_gen) of the CTE pairs(id, note, gen)."""
    return f"""
{name}_n as (select id, {numbers("note")} as n, {numbers("gen")} as g from {pairs}),
{name} as (select id, case when len(n) = 0 then 1.0::double else len(list_intersect(n, g)) / len(n) end as recall,
  case when len(g) = 0 then 1.0::double else len(list_intersect(n, g)) / len(g) end as prec, len(n) as n_note, len(g) as n_gen from {name}_n)"""


def flags(x: str) -> str:
    t = trim(x)
    n = f"len(regexp_extract_all({t}, '(?m)^(?:Doctor|Patient):'))"
    prefix = f"case when {trim(f'''string_split(regexp_replace({t}, '(?m)^(Doctor|Patient):', chr(1) || '\\1:', 'g'), chr(1))[1]''')} = '' then 0 else 1 end"
    return (
        f"regexp_matches({t}, '^(Doctor|Patient):') as starts_with_turn_marker, case when {n} > 0 then {n} + {prefix} else 0 end as num_turns, "
        f"regexp_matches({t}, '(?m)^Doctor:') as has_doctor_turn, regexp_matches({t}, '(?m)^Patient:') as has_patient_turn"
    )


def successor(name: str, source: str, key: str, value: str, seed: int = 42) -> str:
    """CTE name(key, value, next)."""
    return f"""
{name} as (select {key}, {value}, coalesce(lead({value}) over (order by {md5_order(seed, key)}),
  first_value({value}) over (order by {md5_order(seed, key)} rows between unbounded preceding and unbounded following)) as next from {source})"""


def splits(name: str, source: str, key: str = "note_id", seed: int = 42) -> str:
    """CTE name: source with a column split."""
    return f"""
{name}_r as (select *, row_number() over (order by {md5_order(seed, key)}) as r, count(*) over () as n from {source}),
{name} as (select * exclude (r, n), case when r <= round_even(n * 0.8, 0) then 'train' when r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) then 'val' else 'test' end as split from {name}_r)"""


BASE = {
    "d": r"""d as (select conv_id, string_agg(case role when 'user' then 'Patient: ' || text when 'assistant' then 'Doctor: ' || text else text end, chr(10) order by turn) as raw
  from conversations group by conv_id)""",
    "s": r"""s as (select conv_id, raw, string_split(regexp_replace(raw, '(?m)^(Doctor|Patient):', chr(1) || '\1:', 'g'), chr(1)) as segs from d)""",
    "b": f"""b as (select conv_id, raw, length(segs[1]) as chars_stripped, substring(raw, length(segs[1]) + 1) as conversation,
  list_filter(list_transform(segs[2:], lambda x: {trim("x")}), lambda x: x <> '') as turns from s)""",
    "n": """n as (select doc_id, 'note-' || substring(sha256(text), 1, 16) as note_id, text from documents)""",
    "u": """u as (select * exclude (k) from (select *, row_number() over (partition by note_id order by doc_id) as k from n) where k = 1)""",
    "p": """p as (select lpad(conv_id::varchar, 12, '0') as note_id, d.text as clinical_note, conversation, turns from b join documents d on d.doc_id = b.conv_id)""",
}
_NEEDS = {"s": "d", "b": "s", "u": "n", "p": "b"}


def query(final: str, *parts: str) -> str:
    """A statement of base expressions by name, other expressions and a final select."""
    names: list[str] = []

    def need(x: str) -> None:
        if x in _NEEDS:
            need(_NEEDS[x])
        if x not in names:
            names.append(x)

    own = []
    for p in parts:
        if p in BASE:
            need(p)
        else:
            own.append(p.strip())
    return re.sub(r"\n\s*\n", "\n", "with recursive " + ",\n".join([BASE[n] for n in names] + own) + "\n" + final)


PROMPT = "'" + text.PROMPT_PREFIX.replace("\n", "' || chr(10) || '") + "'"
