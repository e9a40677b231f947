"""Licence scans by canonical digest.

A text is brought to a canonical form and the SHA-256 of the whole form is joined to the
digests of known licences.  The form leaves out case, punctuation (comment marks with it),
copyright lines, "all rights reserved" lines and title lines at the top, and has one spelling
of equivalent words and one holder's name in the clause on endorsement.  Lines of a document
count as texts of their own for the known one-line notices.  All in DataFrame functions; the
known digests are small fixed tables, or the caller's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("honour", "honor"), ("authorised", "authorized"), ("whilst", "while"), ("https://", "http://"),
)

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Whole texts of licences.
TEXTS = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. " + _ISC_END
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_END,
    "MIT-0": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so. " + _NO_WARRANTY
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE. For more information, please refer to <http://unlicense.org/>"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in "
        "all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
        "generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
#: One-line notices.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "GPL-3.0": ("Licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "MIT": ("Licensed under the MIT License.", "Released under the MIT License.", "This code is released under the MIT License.", "SPDX-License-Identifier: MIT"),
}

#: Canonical digests of whole texts that are too long to be told here, as their publishers and Debian spread them.
DIGESTS = {
    # With the appendix and without.
    "Apache-2.0": ("d711f2e1f1a0c8a5ca17e04167d59ac7b855cdd2bb99a9c7b6a8179bedd754c9", "5792cda8f223cf3e87d9017905b9c47d0ee85ae03e873648472da2425f818c33"),
    "Artistic-1.0-Perl": ("09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("2f75fa79b178d495a9ab6b69b82e5502c3cb2012aff01a5b63768646ace39d89",),
    "GFDL-1.3": ("2b0aab60b751972557008e87c702427490cdc2d749c1d4fd0b7fca5016b92e69",),
    "GPL-1.0": ("9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c",),
    "GPL-2.0": ("29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f",),
    "GPL-3.0": ("bf9e206799496404ec781ceaf777966308e875445239b2a25248b6a0f817844d",),
    "LGPL-2.0": ("f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e",),
    "LGPL-2.1": ("50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4",),
    "LGPL-3.0": ("e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765",),
    "MPL-1.1": ("93a8d1fdbe0e5aae4693453ab1b3c1237c1609cbae0db2f2983a8dcb98ae21a9",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
}

# Patterns for lower-case text; ^ means after a line feed only.  A quantifier before POSSESSIVE never gives back, so that
# Java loops over it instead of recursing once a line; an engine that keeps no stack goes without the sign.
POSSESSIVE = "<possessive>"
_PLAIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# A copyright line names a year, a sign or a holder; "copyright notice, this list of" in a wrapped text does not.
_COPYRIGHT = (
    r"^[^\w\n]*(?:copyright[\x20\t]*(?:\(c\)|©|[\[<{(:]|\d|by\b)|portions[\x20\t]+copyright[\x20\t]|copyright[^\n]*\b(?:19|20)\d\d|\(c\)[\x20\t]*(?:copyright|\d)|©)[^\n]*"
)
_RIGHTS = r"^[^\w\n]*all rights reserved[^\w\n]*"
# Lines that go on from a copyright line start with blanks or comment marks, and a year.
_LINES = (_COPYRIGHT + rf"(?:\n[\x20\t*#/;-]*(?:19|20)\d\d\b[^\n]*)*{POSSESSIVE}(?:\n|\z)", _RIGHTS + r"(?:\n|\z)")
_TITLE = rf"\A{_PLAIN}*(?:(?:[^\n.]{{0,60}}\blicen[cs]e\b[^\n.]{{0,40}}|copyright[\x20\t][^\n]*)\n{_PLAIN}*)+{POSSESSIVE}"
_SIGNS = r"\x{A0}‘’“”„–—•·…"
_NOT_WORD = _PLAIN[:-1] + _SIGNS + "]+"
_HOLDER = r"\bneither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|any|their) contributors"
_ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors"


def _java(pattern: str) -> str:
    return pattern.replace(POSSESSIVE, "+")


def _spelt(t: Column) -> Column:
    return reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), SPELLINGS, t)


def canonical(text: Column) -> Column:
    """Canonical form; null stays null."""
    t = F.lower(text)
    for p in _LINES:
        t = F.regexp_replace(t, "(?dm)" + _java(p), "")
    t = _spelt(F.regexp_replace(t, _java(_TITLE), ""))
    return F.regexp_replace(F.trim(F.regexp_replace(t, _NOT_WORD, " ")), _HOLDER, _ANY_HOLDER)


def line_digests(text: Column) -> Column:
    """Digests of the canonical forms of a text's distinct lines, each as a text of its own.  What goes letter by letter is
    done to the whole text at once: a line has no title line before it and none goes on from it."""
    t = F.lower(text)
    for p in (_COPYRIGHT, _RIGHTS):
        t = F.regexp_replace(t, rf"(?dm){p}(?=\n|\z)", "")
    plain = F.regexp_replace(_spelt(t), _NOT_WORD.replace(r"\x00-\x2F", r"\x00-\x09\x0B-\x2F"), " ")
    lines = F.array_distinct(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)))
    held = lambda x: F.when(F.contains(x, F.lit("neither the name")), F.regexp_replace(x, _HOLDER, _ANY_HOLDER)).otherwise(x)
    return F.array_distinct(F.transform(lines, lambda x: F.sha2(held(x).cast("binary"), 256)))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(digest, licence) of the texts and of the notices."""
    texts = spark.createDataFrame(list(TEXTS.items()), "licence string, text string")
    lines = spark.createDataFrame([(k, x) for k, v in NOTICES.items() for x in v], "licence string, text string")
    texts, lines = (x.select(digest(F.col("text")).alias("digest"), "licence").distinct() for x in (texts, lines))
    return texts.union(spark.createDataFrame([(d, k) for k, v in DIGESTS.items() for d in v], "digest string, licence string")), lines


def scan(docs: DataFrame, texts: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, licence (null if the text is none that is known) and notices (licences of known
    one-line notices, sorted, comma-joined) of every row of docs(doc_id, text, ...); other columns are not read.

    texts and notices: other (digest, licence) tables; of several licences of one text digest the
    first by name counts, a line counts for all of its own.  Every line is looked up.  A null text counts
    as empty, a null doc_id stays null, repeated rows are answered one by one, an empty table gives an
    empty result.
    """
    own_texts, own_notices = known(docs.sparkSession)
    texts = (own_texts if texts is None else texts).groupBy("digest").agg(F.min("licence").alias("licence"))
    notices = (own_notices if notices is None else notices).select("digest", "licence").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    # Equal texts have equal notices, so they share a key.
    lines = rows.select("key", F.explode(line_digests(F.col("text"))).alias("digest"))
    seen = lines.join(notices, "digest").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    out = rows.select("doc_id", digest(F.col("text")).alias("digest"), "key").join(texts, "digest", "left").join(seen, "key", "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def _re2(pattern: str) -> str:
    return pattern.replace(POSSESSIVE, "")


def _sql_canonical(x: str) -> str:
    out = f"lower({x})"
    for p in _LINES:
        out = f"regexp_replace({out}, '(?m){_re2(p)}', '', 'g')"
    out = f"regexp_replace({out}, '{_re2(_TITLE)}', '')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256(regexp_replace(trim(regexp_replace({out}, '{_NOT_WORD}', ' ', 'g')), '{_HOLDER}', '{_ANY_HOLDER}', 'g'))"


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in rows)


ORACLE_SQL = f"""
with texts(licence, t) as (values {_values(list(TEXTS.items()))}),
notices(licence, t) as (values {_values([(k, x) for k, v in NOTICES.items() for x in v])}),
known_texts as (select min(licence) as licence, digest from (select licence, {_sql_canonical("t")} as digest from texts union all values {_values([(k, d) for k, v in DIGESTS.items() for d in v])}) group by digest),
known_notices as (select distinct licence, {_sql_canonical("t")} as digest from notices),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, unnest(string_split(text, chr(10))) as line from docs),
seen as (select r, string_agg(distinct n.licence, ',' order by n.licence) as notices
  from (select r, {_sql_canonical("line")} as digest from lines) x join known_notices n using (digest) group by r),
found as (select r, doc_id, {_sql_canonical("text")} as digest from docs)
select doc_id, f.digest, k.licence, coalesce(s.notices, '') as notices
from found f left join known_texts k on f.digest = k.digest left join seen s using (r)
"""
