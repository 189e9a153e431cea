"""License scans: whole texts and their lines looked up by the digest of their canonical form."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import LOWER, UPPER, read_table

_MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_CONDITIONS = """Copyright (c) <year> <owner>. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: (licence, text): fixed values, whole licence texts and the one-line notices that stand for them.
KNOWN = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_END),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_THIRD + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Full licence texts, a file each, named by the licence; looked up besides KNOWN.
FULL_TEXTS = Path(__file__).resolve().parent / "licence_texts"
#: Behind this line stands advice on how to apply the licence, which many copies leave out.
TERMS_END = r"(?m)^\s*END OF TERMS AND CONDITIONS\s*$"
#: (pattern, replacement) on lower-cased words: spellings that mean the same.
SPELLINGS = [
    (r"\blicence", "license"),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-infringement", "noninfringement"),
    (r"\bmerchantibility", "merchantability"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\band/or\b", "and or"),
    (r"https://", "http://"),
]
#: A line that only names who holds the copyright, or that all rights are reserved.
COPYRIGHT_LINE = r"^[\s*/#;-]*(copyright\b|\(c\)|©|all rights reserved[.]?\s*$)"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: What the core of a text goes without: signs of list items wherever a line break falls, lines that name
#: the holder (no wrapped line of a sentence looks so), and the canonical lines of the heading.
LIST_MARK = r"(?<!\S)\(?(?:[0-9]{1,2}|[a-z])[.)](?=\s)"
HOLDER_LINE = r"^[\s*/#;-]*(copyright\s*(\(c\)|©|[0-9<\[{])|\(c\)\s*[0-9<\[{]|©|all rights reserved[.]?\s*$)"
TITLE = (r"^((the )?([a-z0-9]+ ){1,6}license( (mit|isc|bsd|expat|mpl|version [0-9 ]+))?|version [0-9 ]+([a-z]+ [0-9]+)?"
         r"|http [a-z0-9 ]+|creative commons legal code|cc0 1 0 universal)$")
#: Known texts are looked up in a broadcast map up to this number; more are joined by shuffling.
MAP_TEXTS = 10_000


def spelled(text: Column) -> Column:
    """Lower case (A-Z) and one spelling."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, replacement in SPELLINGS:
        lowered = F.regexp_replace(lowered, pattern, replacement)
    return lowered


def canonical_lines(text: Column) -> Column:
    """Each line of a spelled text in canonical form, words joined by one blank, and whether it is a copyright line."""
    return F.transform(F.split(text, "\n"), lambda line: F.struct(
        F.trim(F.regexp_replace(line, PUNCTUATION, " ")).alias("words"), F.rlike(line, F.lit(COPYRIGHT_LINE)).alias("holder")))


def core_digest(text: Column) -> Column:
    """The digest of a spelled text without its heading, list marks and holder lines, however its lines are wrapped; null if nothing is left."""
    plain = F.filter(F.split(F.regexp_replace(text, LIST_MARK, " "), "\n"), lambda line: ~F.rlike(line, F.lit(HOLDER_LINE)))
    words = F.filter(F.transform(plain, lambda line: F.trim(F.regexp_replace(line, PUNCTUATION, " "))), lambda w: w != "")
    start = F.array_position(F.transform(words, lambda w: F.rlike(w, F.lit(TITLE))), False)
    return F.when(start > 0, F.sha2(F.array_join(F.slice(words, start.cast("int"), F.size(words)), " "), 256))


def whole_form(lines: Column) -> Column:
    """The canonical text: its lines without the copyright lines, joined by one blank; one of copyright lines only keeps them."""
    def joined(some: Column) -> Column:
        return F.array_join(F.filter(F.transform(some, lambda line: line["words"]), lambda words: words != ""), " ")

    bare = joined(F.filter(lines, lambda line: ~line["holder"]))
    return F.when(bare != "", bare).otherwise(joined(lines))


def full_texts() -> list[tuple[str, str]]:
    """(licence, text): whole licence texts, also as they stand without the advice behind their terms."""
    out = []
    for path in sorted(FULL_TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        end = re.search(TERMS_END, text)
        out += [(path.stem, part) for part in [text, *([text[: end.end()], text[: end.start()]] if end else [])]]
    return out


def _by_digest(table: DataFrame) -> DataFrame:
    return table.filter("digest is not null").distinct().groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license of the known texts; a digest that two licences share names both."""
    table = spark.createDataFrame(KNOWN + full_texts() if known is None else known, "license string, text string")
    each = table.select(canonical_lines(spelled(F.col("text"))).alias("lines"), "license")
    return _by_digest(each.select(F.sha2(whole_form(F.col("lines")), 256).alias("digest"), "license"))


def known_cores(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest (of the core), license of the known texts; the one-line notices have no heading and are left out."""
    some = [(name, text) for name, text in (KNOWN + full_texts() if known is None else known) if "\n" in text]
    table = spark.createDataFrame(some, "license string, text string")
    return _by_digest(table.select(core_digest(spelled(F.col("text"))).alias("digest"), "license"))


def scan(docs: DataFrame, known: DataFrame | None = None, cores: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, digest, license (of the whole text, null if unknown), notices (licences of single lines, sorted), notice_lines.

    The digest of the whole canonical text is hash-joined with the known ones, and that of its core with
    theirs where the first finds none; each line is also looked up, as a text of its own. Null and empty texts have the digest of the empty text and match nothing. Rows are
    independent: repeated ones give repeated results, other columns are not carried and may have any name;
    an empty table gives none.
    """
    if cores is None:
        cores = known_cores(docs.sparkSession) if known is None else known.limit(0)
    known = (known_digests(docs.sparkSession) if known is None else known).select("digest", "license")
    plain = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # the spelled text is a column of its own, so that it is made once for both forms
    lines = plain.withColumn("_spelled", spelled(F.col("_text"))).withColumn("_lines", canonical_lines(F.col("_spelled")))
    digests = F.transform(F.filter("_lines", lambda line: line["words"] != ""), lambda line: F.sha2(line["words"], 256))
    marked = lines.withColumn("digest", F.sha2(whole_form(F.col("_lines")), 256)).withColumn("_line_digests", digests).withColumn("_core", core_digest(F.col("_spelled")))
    if known.limit(MAP_TEXTS + 1).count() <= MAP_TEXTS:
        table = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))))
        found = F.filter(F.transform("_line_digests", lambda x: F.try_element_at(F.col("_known"), x)), lambda x: x.isNotNull())
        named = marked.withColumn("_known", table.scalar()).withColumn("_found", found)
    else:  # notices depend on the text alone, so they are found once for each distinct text
        marked = marked.withColumn("_raw", F.sha2("_text", 256))
        each = marked.dropDuplicates(["_raw"]).select("_raw", F.explode("_line_digests").alias("digest"))
        hits = each.join(known, "digest").groupBy("_raw").agg(F.collect_list("license").alias("_found"))
        named = marked.join(hits, "_raw", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    whole = known.select(F.col("digest"), F.col("license"))
    other = cores.select(F.col("digest").alias("_core"), F.col("license").alias("_core_license"))
    return named.join(whole, "digest", "left").join(other, "_core", "left").select(
        F.col("_key").alias(key), "digest", F.coalesce("license", "_core_license").alias("license"),
        F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"),
        F.size("_found").cast("long").alias("notice_lines"))


def op5_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan(read_table(spark, folder, "documents"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_spelled(column: str) -> str:
    out = f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"
    for pattern, replacement in SPELLINGS:
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(replacement)}, 'g')"
    return out


SQL = f"""
WITH texts AS (
    SELECT doc_id, NULL AS license, {_sql_spelled('text')} AS t FROM documents
    UNION ALL SELECT NULL, license, {_sql_spelled('text')} FROM (VALUES {', '.join(f'({_sql_text(a)}, {_sql_text(b)})' for a, b in KNOWN)}) AS k(license, text)),
forms AS (
    SELECT doc_id, license,
           [trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) FOR x IN string_split(t, chr(10))
            IF NOT regexp_matches(x, '{COPYRIGHT_LINE}')] AS bare,
           [trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) FOR x IN string_split(t, chr(10))] AS lines
    FROM texts),
digests AS (
    SELECT doc_id, license, list_filter(lines, lambda x: x <> '') AS lines,
           sha256(coalesce(nullif(array_to_string(list_filter(bare, lambda x: x <> ''), ' '), ''),
                           array_to_string(list_filter(lines, lambda x: x <> ''), ' '))) AS digest
    FROM forms),
known AS (SELECT digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license FROM digests WHERE doc_id IS NULL GROUP BY digest),
hits AS (
    SELECT doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices, count(*) AS n
    FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM digests WHERE doc_id IS NOT NULL) JOIN known k USING (digest)
    GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(notices, '') AS notices, coalesce(n, 0) AS notice_lines
FROM digests d LEFT JOIN known k USING (digest) LEFT JOIN hits h ON h.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL
"""
