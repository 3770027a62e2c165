"""Noise filters on hunks: whitespace-only, comment-only, meaningful."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions.dialect import BLANK
from diffloom.functions.rules import COMMENT_STARTS, COMMENT_STARTS_OTHER
from diffloom.functions.text import ADD_MARK, CHANGED_MARK, DEL_MARK, computed, count_changed, let


def whitespace_only(hunk: Column) -> Column:
    """The added and the removed lines are the same multiset of token lists."""
    added, deleted = count_changed(hunk, "+"), count_changed(hunk, "-")

    def same(squeezed: Column) -> Column:
        def tokens(mark: str) -> Column:
            line = F.lit(rf"(?md)^{mark} ?(.*?) ?$")
            return F.array_sort(F.regexp_extract_all(squeezed, line, F.lit(1)))

        return tokens(ADD_MARK) == tokens(DEL_MARK)

    # Sorting is only reached when both sides have the same number of lines.
    return (
        F.when((added == 0) | (added != deleted), False)
        .otherwise(let(F.regexp_replace(hunk, f"[{BLANK}]+", " "), same))
    )


def non_comment_line(starts: list[str]) -> str:
    harmless = "|".join(["$", *map(re.escape, starts)])
    return rf"(?md)^{CHANGED_MARK}(?![{BLANK}]*+(?:{harmless}))"


def comment_only(hunk: Column, ext: Column) -> Column:
    """Every changed line is blank or starts with a comment token."""
    other = ~hunk.rlike(non_comment_line(COMMENT_STARTS_OTHER))
    clean = F.when(ext.isNull(), other)
    for name, starts in COMMENT_STARTS.items():
        clean = clean.when(ext == name, ~hunk.rlike(non_comment_line(starts)))
    return hunk.rlike(rf"(?md)^{CHANGED_MARK}") & clean.otherwise(other)


def meaningful(
    hunks: Column, ext: Column, skip_whitespace: bool = True, skip_comments: bool = True
) -> Column:
    """Array of hunks without the noise the switches name."""
    if skip_comments:
        hunks = F.filter(hunks, lambda h: ~comment_only(h, ext))
    if skip_whitespace:
        hunks = F.filter(hunks, lambda h: ~whitespace_only(h))
    return hunks


def with_noise_flags(hunks: DataFrame) -> DataFrame:
    """Hunk table with ``ws_only`` and ``comment_only`` columns."""
    return hunks.select(
        "*",
        whitespace_only(F.col("text")).alias("ws_only"),
        comment_only(F.col("text"), F.col("extension")).alias("comment_only"),
    )


def with_meaningful(
    files: DataFrame, skip_whitespace: bool = True, skip_comments: bool = True
) -> DataFrame:
    """File table with the array ``kept_hunks`` and its size ``n_kept``."""
    kept = meaningful(F.col("hunks"), F.col("extension"), skip_whitespace, skip_comments)
    return computed(files, kept_hunks=kept).withColumn("n_kept", F.size("kept_hunks"))
