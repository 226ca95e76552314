"""License scan: canonical digests of whole texts and lines, joined with known ones.

A text is brought to a canonical form: lower case, equivalent spellings made one,
copyright lines dropped, punctuation and white space reduced to single blanks. Two
texts with one canonical form are the same licence, and its SHA-256 stands for it. The
digests of whole documents and of their single lines are looked up by a join, so no
text is compared with another one.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.operators.common import compute_once
from civitext.session import broadcast_if_small

# Licences and notices by name, in full.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
LICENCES = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
# Spellings that count as one, as (from, to), in lower case.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("http", "https"),
]
# A line that starts with a copyright mark, and "all rights reserved" on its own.
COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(?:copyright\\b[^\\n]*(?:[0-9]{4}|\\(c\\)|©)|\\(c\\)|©|all rights reserved\\b)[^\\n]*$"


def canonical(text: Column) -> Column:
    """Canonical form of a text; empty for a null one and one without letters or digits.

    Words stand between two blanks each, so that a spelling is a plain replacement of
    whole words, also where one follows itself.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", "  ")), F.lit(" "))
    for one, other in SPELLINGS:
        one, other = (" " + "  ".join(words.split()) + " " for words in (one, other))
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(out)


def with_digest(df: DataFrame, text: str) -> DataFrame:
    """Adds `digest`, the SHA-256 of a text's canonical form; rows with an empty form are dropped."""
    formed = compute_once(df, "_form", canonical(F.col(text))).filter("_form <> ''")
    return formed.withColumn("digest", F.sha2("_form", 256)).drop("_form")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license) of known licences: pairs (name, text), or a table with these columns."""
    if not isinstance(known, DataFrame):
        pairs = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in known or LICENCES]
        known = spark.range(1).select(F.inline(F.array(*pairs)))
    rows = with_digest(known.select("name", "text"), "text")
    return rows.groupBy("digest").agg(F.min("name").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit, line_no, license, digest) of every known licence in `docs`.

    unit is `text` if the whole text is the licence, and `line` if one of its lines is,
    with the line's number from 0. Null, empty and other texts have no result; repeated
    rows have results of their own, a null key stays null. The known side is as long as
    the list of licences: it is broadcast after counting it, so that a line which stands
    in a third of all documents is no hot key.
    """
    known = broadcast_if_small(known)
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = docs.select(F.col(f"`{key}`").alias(key), F.lit("text").alias("unit"), F.lit(None).cast("int").alias("line_no"), own.alias("part"))
    lines = docs.select(F.col(f"`{key}`").alias(key), F.posexplode(F.split(own, "\n", -1)).alias("line_no", "part"))
    lines = lines.select(key, F.lit("line").alias("unit"), "line_no", "part")
    units = whole.unionByName(lines)
    found = with_digest(units, "part").join(known, "digest")
    return found.select(key, "unit", "line_no", "license", "digest")
