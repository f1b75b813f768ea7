"""License scans by canonical digests, in DataFrame functions only.

A text is put into canonical form (ASCII case, punctuation, copyright statements,
equivalent spellings, white space), digested, and joined by digest to a table of
known licences. The whole document is one such text; every line of it that names
a licence is another, for notices that stand inside other text.

Defined cases: a copyright statement ends with its line, so the wrapped rest of
one stays in the text; a null text is empty and matches nothing; several known licences
of one digest are all reported; repeated rows are judged one by one; a null id
stays a row of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.llm.license_texts import TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What counts as punctuation, a copyright line and the same word.
# A statement is a line that begins with copyright and a sign, a year or a year's placeholder, or with a sign and a year; a sentence of
# the licence that is wrapped before its word copyright is none. "All rights reserved" is one wherever it stands or is wrapped.
_YEAR = r"[0-9]{4}|[<\[{]+ ?(year|yyyy)"
_RESERVED = r"[^a-z0-9]+rights[^a-z0-9]+reserved"
COPYRIGHT = (
    rf"(^|\n)[^\na-z0-9]*(copyright[ \t:]*(\(c\)|©|{_YEAR})|\(c\)[ \t]*(copyright[ \t:]*)?({_YEAR})|©)"
    rf"([^\n]*[^\na-z0-9]all{_RESERVED})?[^\n]*|(^|[^a-z0-9])all{_RESERVED}"
)
PUNCTUATION = "[\\x00-\\x20!-/:-@\\[-`{-~]+"
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("whilst", "while"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"),
]

#: Known notices, the ISC text on two lines and, added below, whole texts; a caller may give any table of (license_id, text).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )),
]
#: Headings under which the short texts are handed round, besides none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense"],
}
_TERMS_END = "END OF TERMS AND CONDITIONS"
#: A line is looked up as a notice of its own if it holds this, in either spelling of the word.
LINE_STEM = "licen"


def whole_texts() -> list[tuple[str, str]]:
    """(license_id, text) of every whole text, in the editions that differ beyond layout."""
    out: dict[tuple[str, str], None] = {}
    for key, text in TEXTS.items():
        name = key.split(" ")[0]
        editions = [text]
        if name.startswith("BSD-"):
            editions.append(re.sub(r"(?m)^[0-9]\. ", "* ", text))
        if _TERMS_END in text:  # without the appendix on how to apply it
            editions.append(text[: text.index(_TERMS_END) + len(_TERMS_END)])
        editions += [re.sub("https?://", f"{scheme}://", x) for x in editions if "://" in x for scheme in ("http", "https")]
        editions += [f"{title}\n\n{x}" for x in editions for title in TITLES.get(name, [])]
        # The GNU texts do not say whether later versions are allowed too; only a notice does.
        ids = [f"{name}-only", f"{name}-or-later"] if name.startswith(("GPL-", "LGPL-", "GFDL-")) else [name]
        out |= dict.fromkeys((i, x) for x in editions for i in ids)
    return list(out)


KNOWN += whole_texts()


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT, "\n")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for written, meant in SPELLINGS:
        out = F.replace(out, F.lit(written), F.lit(meant))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """digest -> sorted licence ids; texts without a word are left out."""
    named = known.where(canonical(F.col("text")) != "")
    return named.select(digest(F.col("text")).alias("known"), F.col("license_id").alias("license_id")).groupBy("known").agg(
        F.sort_array(F.collect_set("license_id")).alias("license_ids")
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license_ids of the whole text, n_notices and notice_ids of its lines."""
    lines = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), "\n"), lambda x: x.contains(LINE_STEM))
    units = F.concat(F.array(digest(F.col("text"))), F.transform(lines, digest))
    # The row number only ties a row's units together again within this plan.
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), units.alias("units"))
    each = rows.select("doc_id", "row", F.posexplode("units").alias("unit", "digest"))
    met = each.join(known_digests(known), F.col("digest") == F.col("known"), "left")
    line = F.when(F.col("unit") > 0, F.col("license_ids"))
    grouped = met.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("unit") == 0, F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(F.col("unit") == 0, F.array_join("license_ids", ","))).alias("license_ids"),
        F.count(line).alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(line)))), ",").alias("notice_ids"),
    )
    return grouped.select("doc_id", "canonical_sha256", F.coalesce("license_ids", F.lit("")).alias("license_ids"), "n_notices", "notice_ids")
