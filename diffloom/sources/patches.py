"""Patch sources: files and tables of whole patch texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators.parse import parse_patches
from diffloom.sources.file_tree import is_hidden, list_files, qualified, read_files, read_ranges

#: Bytes of a piece of a patch file, about; a longer file entry is in several pieces.
PIECE_BYTES = 16 << 20


def read_patch_files(spark: SparkSession, path: str | list[str], hidden: bool = False) -> DataFrame:
    """One row per patch file: ``patch_id`` is its path, bad bytes become U+FFFD.

    Spark's listing leaves out names that start with a dot or underscore.  With ``hidden``
    such files are listed and read as well, at any depth; ``path`` has to be a folder then.
    Use :func:`read_patch_pieces` for files larger than a row.
    """
    shown = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("patch_id"), F.make_valid_utf8("value").alias("content")
    )
    if not hidden:
        return shown
    rest = read_files(list_files(spark, path).where(is_hidden(F.col("path"))), path)
    return shown.unionByName(
        rest.where(F.length("content") > 0).select(
            F.concat(F.lit(qualified(spark, path).rstrip("/") + "/"), "path").alias("patch_id"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        )
    )


def read_patch_pieces(
    spark: SparkSession, folder: str, exclude: Iterable[str] = (), piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """``patch_id, piece_no, content`` of all patch files below a folder, of any size.

    A file is cut at headers of file entries, about every ``piece_bytes``, by the tasks that
    read its ranges, so neither a task nor a row holds a whole file.  ``patch_id`` is the
    path below the folder.  For :mod:`diffloom.operators.pieces`.
    """
    pieces = read_ranges(list_files(spark, folder, exclude), folder, piece_bytes)
    return pieces.select(
        F.col("path").alias("patch_id"),
        "piece_no",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def patch_table(table: DataFrame, patch_id: str, content: str) -> DataFrame:
    """Use two columns of any table as patches."""
    return table.select(
        F.col(patch_id).cast("string").alias("patch_id"), F.col(content).alias("content")
    )


def load_patches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """File table of all patch files under ``path``."""
    return parse_patches(read_patch_files(spark, path))
