"""Licence texts found by the digest of their canonical form.

The canonical form of a text lower-cases it, drops lines that state a copyright, joins
equivalent spellings, turns runs of punctuation and white space into one space and
drops empty lines.  Whole documents and whole lines (a notice often stands alone) are
looked up by the SHA-256 of that form in a table of known licences with a hash join;
no text is compared with another one.

Defined results: a null text counts as empty; a text or line without letters and digits
has the digest of the empty string and matches nothing; repeated rows are looked up each
on its own; a known text given twice under different names yields the alphabetically
first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions.text import computed
from diffloom.storage import stored

#: Pattern -> replacement, in this order, on lower-cased text.
SPELLINGS = [
    (r"https?://", ""),
    (r"licence", "license"),
    (r"licensor[s']*", "licensor"),
    (r"\b(v|ver|vers|version)[. ]*([0-9])", "version $2"),
    (r"([0-9])\.0\b", "$1"),
    (r"&", " and "),
    (r"\(c\)|©", "copyright "),
    (r"analogue", "analog"),
    (r"noninfringement|non infringement", "non-infringement"),
    (r"sub license|sub-license", "sublicense"),
    (r"per cent", "percent"),
    (r"owner", "holder"),
]
COPYRIGHT = r"^\W*(copyright|\(c\)|©|all rights reserved)"
NOT_A_WORD = r"[^\p{L}\p{N}]+"

#: Names and notices of well-known licences, stated as short texts.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; '' for a copyright line."""
    text = F.lower(line)
    spelled = text
    for pattern, spelling in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, spelling)
    words = F.trim(F.regexp_replace(spelled, NOT_A_WORD, " "))
    return F.when(text.rlike(COPYRIGHT), F.lit("")).otherwise(words)


def canonical_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    return F.filter(F.transform(lines, canonical_line), lambda line: line != "")


def canonical_text(text: Column) -> Column:
    return F.array_join(canonical_lines(text), " ")


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license_id of a table (license_id, text); one row per digest."""
    digests = known.select(
        "license_id", canonical_text(F.col("text")).alias("_text")
    ).where("_text != ''")
    return digests.groupBy(F.sha2("_text", 256).alias("digest")).agg(
        F.min("license_id").alias("license_id")
    )


def license_scan(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, digest, license_id of the whole text, notices in its lines.

    ``notices`` holds each licence once, in order, and is empty where there is none.
    The lookups happen on digests only; texts do not leave their task.
    """
    digests = known_digests(known)
    own = docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text")
    )
    # Stored, each text is canonicalised once and rows keep their numbers.
    rows = stored(
        computed(own, _lines=canonical_lines(F.col("_text"))).select(
            "_id", "_row",
            F.sha2(F.array_join("_lines", " "), 256).alias("digest"),
            F.transform(F.array_distinct("_lines"), lambda line: F.sha2(line, 256)).alias("_digests"),
        )
    )
    found = (
        rows.select("_row", F.explode("_digests").alias("digest"))
        .join(digests, "digest")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_set("license_id")).alias("_notices"))
    )
    return (
        rows.drop("_digests")
        .join(digests, "digest", "left")
        .join(found, "_row", "left")
        .select(
            F.col("_id").alias(id_col),
            "digest",
            "license_id",
            F.coalesce("_notices", F.array().cast("array<string>")).alias("notices"),
        )
    )
