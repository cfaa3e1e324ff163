"""Licence scans (operator 5): canonical digest lookup.

A text is brought to a canonical form: lower case; copyright lines gone;
everything that is neither letter nor digit one blank, line ends kept; spellings
that licences use alike brought to one.  The digest of the whole canonical text
is hash-joined to the digests of known licences, and every whole line that
equals a known text as well is listed as a notice.  All of it is column
expressions; each spelling rule first looks for a plain piece of text, so texts
without it are not searched by the rule.

The known licences are a parameter; their digests are broadcast, and at most
``MAX_KNOWN`` are accepted.

Defined results: a null text is an empty text; an empty canonical text matches
nothing; texts of any length are digested whole; repeated rows give repeated
rows; of several licences with one digest the first name counts; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.llm.common import table
from donorlift.llm.queries import query

#: Known licences accepted in one scan; their digests are broadcast.
MAX_KNOWN = 100_000

# Spellings that licence matching treats as equal, as
# (plain text that must occur, pattern, replacement).
SPELLINGS = [
    ("licenc", r"\blicenc(e|ed|es|ing|ee|ees)\b", r"licens\1"),
    ("sub", r"\bsub[ \n]+licens", r"sublicens"),
    ("non", r"\bnon[ \n]+commercial", r"noncommercial"),
    ("per", r"\bper[ \n]+cent\b", r"percent"),
    ("copyright", r"\bcopyright[ \n]+owner", r"copyright holder"),
    ("https", r"\bhttps\b", r"http"),
    ("is", r"\b(author|capital|emphas|initial|maxim|optim|organ|real|recogn|util)is(e|ed|es|ing|ation|ations)\b", r"\1iz\2"),
    ("our", r"\b(behavi|col|fav|hon|lab)our", r"\1or"),
    ("gement", r"\b(acknowled|jud)gement", r"\1gment"),
    ("ll", r"\b(cancel|label|model|signal)l(ed|ing)\b", r"\1\2"),
    ("whilst", r"\bwhilst\b", r"while"),
    ("ogue", r"\b(anal|catal)ogue", r"\1og"),
    ("centre", r"\bcentre", r"center"),
    ("artefact", r"\bartefact", r"artifact"),
    ("analys", r"\banalys(e|ed|es|ing)\b", r"analyz\1"),
    ("fulfil", r"\bfulfil(ment)?\b", r"fulfill\1"),
    ("practis", r"\bpractis(e|ed|es|ing)\b", r"practic\1"),
    ("programme", r"\bprogramme\b", r"program"),
    ("offence", r"\boffence", r"offense"),
]
COPYRIGHT_LINE = r"(?m)^[\t *#/;>-]*(copyright[\t ]*(\(c\)|©|[0-9]{4}|:|by\b|<|\[)|\(c\)[\t ]*[0-9]{4}|©|all rights reserved).*$"
BETWEEN = r"[^\p{L}\p{N}\n]+"

_PERMISSION = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Texts of short licences and usual notices, by SPDX name.
KNOWN = {
    "0BSD": _PERMISSION.format(""),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": _PERMISSION.format(", provided that the above copyright notice and this permission notice appear in all copies"),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT notice": "Released under the MIT License.",
}


def _where(x: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of a text that passes a cheap test, else the text.  The
    lambda names the text once, so that nested steps stay linear in size."""
    return F.element_at(F.transform(F.array(x), lambda v: F.when(test(v), change(v)).otherwise(v)), 1)


def canonical(text: Column) -> Column:
    """The canonical form of a text, lines kept."""
    out = F.lower(F.coalesce(text, F.lit("")))
    marks = lambda v: v.contains("copyright") | v.contains("(c)") | v.contains("©") | v.contains("all rights reserved")
    out = _where(out, marks, lambda v: F.regexp_replace(v, COPYRIGHT_LINE, ""))
    out = F.regexp_replace(out, BETWEEN, " ")
    for plain, pattern, to in SPELLINGS:
        out = _where(out, lambda v, p=plain: v.contains(p), lambda v, p=pattern, t=to: F.regexp_replace(v, p, t.replace("\\", "$")))
    return out


def one_line(lines: Column) -> Column:
    """Canonical text as one line."""
    return F.btrim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: dict[str, str]) -> list[tuple[str, str, int]]:
    """(digest, name, length) of known licences."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known licences, got {len(known)}")
    if not known:
        return []
    line = one_line(canonical(F.col("text")))
    rows = spark.createDataFrame(sorted(known.items()), "name string, text string").select("name", line.alias("line")).select("name", F.sha2("line", 256).alias("d"), F.length("line").alias("n"))
    first: dict[str, tuple] = {}
    for r in sorted(rows.collect()):
        if r.n:
            first.setdefault(r.d, (r.d, r.name, r.n))
    return sorted(first.values())


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Per document: digest of its canonical text, the licence that it is as a
    whole, the notices among its lines (sorted names) and their number."""
    spark = docs.sparkSession
    digests = known_digests(spark, KNOWN if known is None else known)
    rows = docs.select("doc_id", canonical(F.col("text")).alias("lines")).select("doc_id", "lines", F.sha2(one_line(F.col("lines")), 256).alias("canonical_sha256"))
    names = F.create_map(*[F.lit(x) for d, name, _ in digests for x in (d, name)]) if digests else F.create_map().cast("map<string,string>")
    lengths = F.array(*[F.lit(n) for n in sorted({n for _, _, n in digests})]) if digests else F.array().cast("array<int>")
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.btrim(x)), lambda x: F.array_contains(lengths, F.length(x)))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "canonical_sha256", found.alias("found"))
    table_of = spark.createDataFrame([(d, name) for d, name, _ in digests], "canonical_sha256 string, license_id string")
    whole = rows.join(F.broadcast(table_of), "canonical_sha256", "left")
    return whole.select("doc_id", "canonical_sha256", "license_id", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def _sql_canonical(x: str) -> str:
    # one pass like Spark's: lower case, copyright lines, blanks, spellings
    out = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT_LINE}', '', 'g'), '{BETWEEN}', ' ', 'g')"
    for _, pattern, to_text in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to_text}', 'g')"
    return out


_quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
SQL = rf"""
WITH k AS (SELECT min(name) AS name, sha256(line) AS d FROM (SELECT name, trim(regexp_replace({_sql_canonical('text')}, '[ \n]+', ' ', 'g')) AS line FROM (VALUES {_quoted}) AS v(name, text)) WHERE line <> '' GROUP BY line),
c AS (SELECT row_number() OVER () AS r, doc_id, {_sql_canonical('text')} AS lines FROM documents),
n AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n FROM (SELECT r, unnest(string_split(lines, chr(10))) AS x FROM c) JOIN k ON k.d = sha256(trim(x)) GROUP BY r)
SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))) AS canonical_sha256, k.name AS license_id, coalesce(notices, '') AS notices, coalesce(n.n, 0) AS n_notices
FROM c LEFT JOIN n USING (r) LEFT JOIN k ON k.d = sha256(trim(regexp_replace(lines, '[ \n]+', ' ', 'g')))
"""


@query("op5_licences", SQL)
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
