"""Line counts, change-set totals and token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.rules import (
    CHARS_PER_TOKEN_CODE,
    CHARS_PER_TOKEN_PROSE,
    USD_PER_1K_TOKENS,
)
from diffloom.functions.text import join_lines
from diffloom.operators.hunk_filters import with_meaningful
from diffloom.operators.parse import changed_only, text_files


def file_stats(files: DataFrame) -> DataFrame:
    """Statistics per file entry, identical entries left out."""
    return changed_only(files).select(
        "patch_id", "file_seq", "path", "extension", "binary", "n_hunks", "added", "deleted"
    )


def patch_totals(files: DataFrame) -> DataFrame:
    """Changed and binary files, lines added and deleted, per patch."""
    return changed_only(files).groupBy("patch_id").agg(
        F.count_if(~F.col("binary")).alias("changed_files"),
        F.count_if("binary").alias("binary_files"),
        F.sum("added").alias("lines_added"),
        F.sum("deleted").alias("lines_deleted"),
    )


def text_tokens(text: Column, is_code: bool = True) -> Column:
    """Token estimate of one text, at least 1."""
    return chars_to_tokens(F.length(text), is_code)


def chars_to_tokens(chars: Column, is_code: bool = True) -> Column:
    divisor = CHARS_PER_TOKEN_CODE if is_code else CHARS_PER_TOKEN_PROSE
    return F.greatest(F.lit(1), F.floor(chars / F.lit(divisor))).cast("bigint")


def prompt_tokens(text: Column) -> Column:
    """Quick estimate for a finished prompt: a quarter of its characters."""
    return F.floor(F.length(text) / 4).cast("bigint")


def file_tokens(
    files: DataFrame, skip_whitespace: bool = True, skip_comments: bool = True
) -> DataFrame:
    """Characters and tokens per file; files without meaningful hunks are left out."""
    kept = with_meaningful(text_files(files), skip_whitespace, skip_comments).where("n_kept > 0")
    chars = kept.select(
        "patch_id", "file_seq", "path", F.length(join_lines(F.col("kept_hunks"))).alias("chars")
    )
    return chars.withColumn("tokens", chars_to_tokens(F.col("chars")))


def path_breakdown(tokens: DataFrame) -> DataFrame:
    """Tokens by path: of two entries for one path the last one counts.

    ``chars`` still adds up all entries and ``first_seq`` is where the path was
    first seen, which is the order of the breakdown.
    """
    return tokens.groupBy("patch_id", "path").agg(
        F.max_by("tokens", "file_seq").alias("tokens"),
        F.sum("chars").alias("chars"),
        F.min("file_seq").alias("first_seq"),
    )


def patch_tokens(tokens: DataFrame) -> DataFrame:
    """Total characters, tokens and cost per patch."""
    return (
        path_breakdown(tokens)
        .groupBy("patch_id")
        .agg(F.sum("chars").alias("total_chars"), F.sum("tokens").alias("total_tokens"))
        .withColumn("cost_usd", cost_usd(F.col("total_tokens")))
    )


def cost_usd(tokens: Column) -> Column:
    return tokens / F.lit(1000) * F.lit(USD_PER_1K_TOKENS)


def token_breakdown(tokens: DataFrame) -> DataFrame:
    """One map path -> tokens per patch, in order of first appearance."""
    entries = F.array_sort(F.collect_list(F.struct("first_seq", "path", "tokens")))
    pairs = F.transform(entries, lambda e: F.struct(e["path"].alias("key"), e["tokens"].alias("value")))
    return path_breakdown(tokens).groupBy("patch_id").agg(F.map_from_entries(pairs).alias("breakdown"))


def top_paths_by_tokens(tokens: DataFrame, limit: int = 10) -> DataFrame:
    """The paths with most tokens of every patch."""
    order = Window.partitionBy("patch_id").orderBy(F.desc("tokens"), "first_seq")
    return (
        path_breakdown(tokens)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("patch_id", "rank", "path", "tokens")
    )


def last_per_path(rows: DataFrame) -> DataFrame:
    """Of several entries for one path of a patch keep the last."""
    last = Window.partitionBy("patch_id", "path").orderBy(F.desc("file_seq"))
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
