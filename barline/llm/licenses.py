"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: copyright lines dropped, lower case,
equivalent spellings replaced, every run of punctuation and white space one
blank.  The SHA-256 of the form is looked up, by a hash join, among the digests
of known licence texts; a match means that the entire texts agree.  The same
lookup is made for single lines that speak of a licence, as notices stand on
lines of their own.

Licences as projects ship them are looked up a second time, by the digest of
a form without title line, copyright statements, list marks and the holders'
names in the BSD texts.  The texts are the files of ``license_texts``, each with
and without what follows its last condition.

Null and empty texts match nothing.  Rows are kept one for one; if several
rows share an id, each shows the notices found under that id.  Input columns
other than the named ones are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: FIXED VALUES: spellings that count as the same, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"),
    ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("(c)", "copyright"), ("©", "copyright"), ("https:", "http:"), ("&", "and"),
    ("\u201c", " "), ("\u201d", " "), ("\u2018", " "), ("\u2019", " "), ("\u2013", " "), ("\u2014", " "), ("\u00a0", " "),
)
#: A line that only states a copyright: after the mark a year or another mark follows, unlike in clauses and wrapped sentences.
COPYRIGHT_LINE = r"(?im)^[ \t]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|<year>|yyyy)[^\n]*$"
#: What a line says that may be a notice.
NOTICE = "licen|released under|permission"
#: What counts as punctuation or space: ASCII other than letters and digits.
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

#: FIXED VALUES: known licence texts and notices.
KNOWN = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0-notice", "Released under CC0 1.0."),
    ("BSD-3-Clause-notice", "Released under the BSD 3-Clause License."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)

#: Whole licence texts, by SPDX id.
TEXTS = Path(__file__).with_name("license_texts")
#: What every whole licence text says somewhere.
SPEAKS = r"(?i)licen[sc]e|permission|redistribution|unencumbered"
#: A first line that names a licence; it is no title if it says under which.
TITLE, NO_TITLE = r"(?i)\A\s*[^\n.]*\blicen[sc]e\b[^\n.]*\n", r"(?i)\A\s*[^\n]*\bunder\b"
#: Lines that state a copyright, unlike lines of a wrapped sentence that begin with the word; list marks.
STATEMENT = r"(?im)^[ \t]*((copyright|\(c\)|©)[^\n]*(\d{4}|yyyy|<year>|\(c\)|©)[^\n]*|all rights reserved\.?[ \t\r]*)$"
LIST_MARK = r"(?m)^[ \t]*(\d{1,2}\.|[*-])[ \t]+"
#: FIXED VALUES: names of holders in the BSD texts, of any length between the fixed words, in the canonical form.
HOLDERS = (
    (r"neither the names? (of )?.+? nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this software is provided by .+? and contributors as is", "this software is provided by the copyright holders and contributors as is"),
    (r"in no event shall .+? or contributors be liable", "in no event shall the copyright holder or contributors be liable"),
)


def canonical(text: Column, dropped: str = COPYRIGHT_LINE) -> Column:
    """The canonical form of a text; null for null."""
    form = F.lower(F.regexp_replace(text, dropped, ""))
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(form, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the canonical form; null for texts without letters or digits."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def shipped_digest(text: Column) -> Column:
    """SHA-256 (hex) of the form without title, statements, list marks and holders; null for texts that can't be licences."""
    body = F.when(text.rlike(NO_TITLE), text).otherwise(F.regexp_replace(text, TITLE, ""))
    form = canonical(F.regexp_replace(body, LIST_MARK, ""), STATEMENT)
    for names, one in HOLDERS:
        form = F.regexp_replace(form, names, one)
    return F.when(text.rlike(SPEAKS) & (form != ""), F.sha2(form, 256))


def shipped_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, shipped) of the whole licence texts, one row for each digest."""
    texts = []
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        conditions, end, _ = text.rpartition("END OF TERMS AND CONDITIONS")
        texts += [(file.stem, t) for t in (text, conditions + end, conditions) if t.strip()]
    rows = spark.createDataFrame(texts, "license_id string, text string")
    return rows.select("license_id", shipped_digest(F.col("text")).alias("shipped")).groupBy("shipped").agg(F.min("license_id").alias("license_id"))


def known_licenses(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """(license_id, digest) of known texts, one row for each digest (the least id)."""
    rows = spark.createDataFrame(list(texts), "license_id string, text string")
    return rows.select("license_id", digest(F.col("text")).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", shipped: DataFrame | None = None, notice: str = NOTICE) -> DataFrame:
    """(doc_id, digest, license_id, notices): the licence that the entire text is,
    or null, and the sorted ids of the notices on its lines.

    ``shipped`` (see ``shipped_licenses``) is for texts whose digest isn't ``known``.
    ``notice`` is what a lower-cased line must say to be looked up as a notice;
    it has to cover what the known notices say.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    whole = base.select("doc_id", digest(F.col("_text")).alias("digest"), *([shipped_digest(F.col("_text")).alias("shipped")] if shipped is not None else [])).join(known, "digest", "left")
    if shipped is not None:
        named = F.broadcast(shipped.withColumnRenamed("license_id", "_shipped"))  # a few rows for each licence
        whole = whole.join(named, "shipped", "left").withColumn("license_id", F.coalesce("license_id", "_shipped")).drop("shipped", "_shipped")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.lower(x).rlike(notice))
    found = base.select("doc_id", F.explode(lines).alias("line")).select("doc_id", digest(F.col("line")).alias("digest")).join(known, "digest").groupBy(F.col("doc_id").alias("_id")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return whole.join(found, whole["doc_id"].eqNullSafe(found["_id"]), "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
