"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (lower case, copyright statements removed,
punctuation and blanks as one space, equivalent spellings made equal), hashed
with SHA-256, and joined on the digest with the known licences, each with and
without its titles.  A copyright statement is a line that starts with the word
or its sign and goes on with a year or another sign, or, at the head of a
paragraph, with a name; "copyright holder", "owner" and "notice" are words of
the licence wherever a line is wrapped.  Whole texts are
looked up, and every whole line of them as a text of its own, which finds the
one-line licence notices inside documents.

Defined cases: null text counts as empty; an empty canonical form (blanks or
copyright statements only) matches nothing; repeated lines count once; repeated rows
get equal rows; with an empty table of known licences nothing matches.  No text
is shuffled, only digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: spellings that count as equal, after lower-casing ---------
EQUIVALENT = [("licence", "license"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"),
              ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"),
              ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("judgement", "judgment"),
              ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("centre", "center"),
              ("modelled", "modeled"), ("utilisation", "utilization"), ("authorised", "authorized"),
              ("recognised", "recognized"), ("https", "http")]
LICENCE_WORDS = ("holder", "notice", "owner")  # after "copyright": part of the licence, not a statement
LEAD = "[ \t\r*#/;-]*"


def _line_not_from(words: tuple[str, ...]) -> str:
    """Pattern of a rest of line that starts with none of ``words`` (spelled out,
    as the patterns are also those of an engine without look-ahead)."""
    heads = sorted({w[0] for w in words})
    longer = [h + f"(?:\n|$|{_line_not_from(tuple(w[1:] for w in words if w[0] == h))})" for h in heads
              if all(len(w) > 1 for w in words if w[0] == h)]
    return "|".join([f"[^{''.join(heads)}\n][^\n]*", *longer])


_GAP = "[ \t\r\n*#/;-]+"
RIGHTS_LINE = f"all{_GAP}rights{_GAP}reserved[.]?"
_SIGN = "(?:©|\\(c\\))"
_DATED = (f"(?:copyright|{_SIGN})[ \t:]*(?:copyright[ \t:]*)?(?:{_SIGN}|[<\\[{{]?(?:[0-9]{{4}}|yyyy|year))"
          f"(?:[^\n]*{RIGHTS_LINE})?[^\n]*")
_NAMED = f"copyright(?:[ \t]+|[ \t]*:[ \t]*)(?:{_line_not_from(LICENCE_WORDS)})"
COPYRIGHT_LINE = (f"(?:(?:^|\n){LEAD}{_DATED}|(?:^|\n[ \t\r]*\n)[ \t\r\n*#/;-]*(?:{_DATED}|{_NAMED}|©[^\n]*)|^[ \t\r\n*#/;-]*(?:{_DATED}|\\(c\\)[^\n]*))"
                  f"(?:\n?{LEAD}(?:{_DATED}|{_NAMED}))*")
NOT_A_WORD = "[^\\p{L}\\p{N}]+"
# ---- fixed values: texts of well-known licences and one-line notices ---------
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", """3. Neither the name of the copyright holder
nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission.
THIS SOFTWARE IS PROVIDED""")
#: Titles that may stand before the text of a licence.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License",
                     "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License",
                     "New BSD License", "Modified BSD License", "BSD License"),
}
# ------------------------------------------------------------------------------


def canonical(text: Column) -> Column:
    """Canonical form of a text column ("" for null)."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, " "), RIGHTS_LINE, " ")
    out = F.trim(F.regexp_replace(out, NOT_A_WORD, " "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the canonical form."""
    return F.sha2(canonical(text), 256)


def titled(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(license_id, text) of every known text, without and with its titles."""
    return [(name, head + text) for name, text in texts.items()
            for head in ("", *(f"{title}\n\n" for title in TITLES.get(name, ())))]


def known_licenses(spark: SparkSession, texts: dict[str, str] = KNOWN) -> DataFrame:
    """(license_id, digest) of a table of licence texts; equal canonical texts
    keep the smallest id."""
    rows = spark.createDataFrame(titled(texts), "license_id string, text string")
    return (rows.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest"))
            .agg(F.min("license_id").alias("license_id")))


def license_scan(docs: DataFrame, known: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, digest of the whole text, license_id of the
    whole text (or null), notices (sorted ids of the licences that are a whole
    line of it)."""
    empty = F.sha2(F.lit(""), 256)
    lines = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), digest))
    units = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("at"),
                        digest(F.col(text)).alias("whole"), lines.alias("lines"))
    # the whole text is one more unit, marked by its place
    each = units.select("doc_id", "at", "whole", F.posexplode(F.concat(F.array("whole"), "lines")).alias("place", "digest"))
    found = each.join(known.where(F.col("digest") != empty), "digest", "left")
    return found.groupBy("at").agg(
        F.max(F.struct("doc_id", "whole")).alias("doc"),
        F.max(F.when(F.col("place") == 0, F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(F.when(F.col("place") > 0, F.col("license_id")))).alias("notices"),
    ).select("doc.doc_id", F.col("doc.whole").alias("digest"), "license_id", "notices")


def oracle(texts: dict[str, str] = KNOWN) -> str:
    """The same result in DuckDB SQL over ``documents`` (notices comma-joined)."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def sql(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        for pattern in (COPYRIGHT_LINE, RIGHTS_LINE, NOT_A_WORD):
            out = f"regexp_replace({out}, {quoted(pattern)}, ' ', 'g')"
        out = f"trim({out}, ' ')"
        for old, new in EQUIVALENT:
            out = f"replace({out}, {quoted(old)}, {quoted(new)})"
        return out

    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in titled(texts))
    return f"""
WITH known AS (SELECT sha256({sql('t')}) AS digest, min(id) AS license_id FROM (VALUES {rows}) AS k(id, t)
               WHERE {sql('t')} <> '' GROUP BY 1),
docs AS (SELECT row_number() OVER () AS pos, doc_id, text, sha256({sql('text')}) AS digest FROM documents),
lines AS (SELECT DISTINCT pos, sha256({sql('line')}) AS digest
          FROM (SELECT pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs)),
notices AS (SELECT pos, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
            FROM lines JOIN known USING (digest) GROUP BY pos)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices
FROM docs d LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (pos)"""
