"""Statistics of patches that come in numbered pieces.

A patch that is too large for one row, or holds a large share of all lines, is
given as ``patch_id, piece_no, content``, each piece a run of whole lines.  A
piece is analysed in its own row and leaves a few numbers per file it touches.
Files and hunks are then numbered by sums over these numbers: first within
blocks of pieces, then over the blocks, so no task handles a whole patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.text import (
    canonical_path,
    count_changed,
    extension,
    join_lines,
    let,
    unify_newlines,
    without_last_newline,
)
from diffloom.operators.parse import (
    BINARY_LINE,
    CONSUMED,
    CUT_FILES,
    CUT_HUNKS,
    NEW_PATH_LINE,
)
from diffloom.storage import stored

# Pieces that one task numbers in a row; larger blocks only make its sort longer.
PIECES_PER_BLOCK = 4096


def _part(segment: Column, number: Column) -> Column:
    """Numbers of one file within a piece; part 0 continues an earlier file.

    ``head_`` counts lines before the first hunk header of the part: they belong
    to the hunk that was open when the piece began, if there was one.
    """

    def describe(hunks: Column) -> Column:
        inner = join_lines(F.slice(hunks, F.lit(2), F.size(hunks)))
        head = F.get(hunks, F.lit(0))

        def count(text: Column, sign: str) -> Column:
            return count_changed(text, sign).cast("bigint")

        old_path = F.regexp_extract(segment, r"\A--- ([^\t\n]*)", 1)
        new_path = F.regexp_extract_all(segment, F.lit(NEW_PATH_LINE), F.lit(1))
        return F.struct(
            number.cast("bigint").alias("part"),
            F.when(number > 0, old_path).alias("old_path"),
            F.try_element_at(new_path, F.lit(-1)).alias("new_path"),
            segment.rlike(BINARY_LINE).alias("binary"),
            (F.size(hunks) - 1).cast("bigint").alias("hunks"),
            count(inner, "+").alias("added"),
            count(inner, "-").alias("deleted"),
            F.when(number == 0, count(head, "+")).otherwise(0).alias("head_added"),
            F.when(number == 0, count(head, "-")).otherwise(0).alias("head_deleted"),
        )

    return let(F.split(F.regexp_replace(segment, CONSUMED, ""), CUT_HUNKS, -1), describe)


def piece_parts(pieces: DataFrame) -> DataFrame:
    """One small row per piece: its parts and what they add to the numbering."""
    text = without_last_newline(F.concat(F.lit("\n"), unify_newlines(F.col("content"))))
    parts = F.transform(F.split(text, CUT_FILES, -1), _part)
    return part_sums(pieces.select("patch_id", "piece_no", parts.alias("parts")))


def part_sums(described: DataFrame) -> DataFrame:
    """What the array ``parts`` of every piece adds to the numbering."""
    hunks = F.transform("parts", lambda p: p["hunks"])
    return described.select(
        "patch_id",
        "piece_no",
        "parts",
        F.floor(F.col("piece_no") / PIECES_PER_BLOCK).alias("block"),
        (F.size("parts") - 1).cast("bigint").alias("files"),
        F.aggregate(hunks, F.lit(0).cast("bigint"), lambda acc, n: acc + n).alias("hunks"),
        F.element_at(hunks, -1).alias("last_hunks"),
    )


def _before(window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def number_pieces(parts: DataFrame) -> DataFrame:
    """Add ``files_before`` and ``open_hunks`` to every piece.

    ``open_hunks`` is how many hunks the file that is open at the start of the
    piece already has.  ``mark`` is the number of hunks seen when the last file
    began; it only grows, so a running maximum carries it.
    """
    in_block = Window.partitionBy("patch_id", "block").orderBy("piece_no")
    earlier = _before(in_block)
    local = parts.select(
        "*",
        _zero(F.sum("files").over(earlier)).alias("files_in"),
        _zero(F.sum("hunks").over(earlier)).alias("hunks_in"),
    ).withColumn(
        "own_mark",
        F.when(F.col("files") > 0, F.col("hunks_in") + F.col("hunks") - F.col("last_hunks")),
    )
    marked = local.withColumn("mark_in", F.max("own_mark").over(earlier))
    blocks = marked.groupBy("patch_id", "block").agg(
        F.sum("files").alias("block_files"),
        F.sum("hunks").alias("block_hunks"),
        F.max("own_mark").alias("block_mark"),
    )
    earlier_blocks = _before(Window.partitionBy("patch_id").orderBy("block"))
    bases = (
        blocks.withColumn("files_base", _zero(F.sum("block_files").over(earlier_blocks)))
        .withColumn("hunks_base", _zero(F.sum("block_hunks").over(earlier_blocks)))
        .withColumn(
            "mark_base", F.max(F.col("hunks_base") + F.col("block_mark")).over(earlier_blocks)
        )
        .select("patch_id", "block", "files_base", "hunks_base", "mark_base")
    )
    joined = marked.join(bases, ["patch_id", "block"])
    mark = F.coalesce(F.col("hunks_base") + F.col("mark_in"), F.col("mark_base"), F.lit(0))
    return joined.select(
        "patch_id",
        "piece_no",
        "parts",
        (F.col("files_base") + F.col("files_in")).alias("files_before"),
        (F.col("hunks_base") + F.col("hunks_in") - mark).alias("open_hunks"),
    )


def piece_files(numbered: DataFrame) -> DataFrame:
    """``patch_id, file_seq, path, extension, binary, n_hunks, added, deleted`` of numbered pieces.

    The aggregation sums numbers with map-side combine, so a file that spans many
    pieces is as cheap as many files.
    """
    parts = numbered.select(
        "patch_id", "piece_no", "files_before", "open_hunks", F.inline_outer("parts")
    )
    in_open_hunk = F.col("open_hunks") > 0
    rows = parts.select(
        "patch_id",
        "piece_no",
        (F.col("files_before") + F.col("part")).alias("file_seq"),
        "old_path",
        "new_path",
        "binary",
        "hunks",
        (F.col("added") + F.when(in_open_hunk, F.col("head_added")).otherwise(0)).alias("added"),
        (F.col("deleted") + F.when(in_open_hunk, F.col("head_deleted")).otherwise(0)).alias("deleted"),
    ).where("file_seq > 0")
    files = rows.groupBy("patch_id", "file_seq").agg(
        F.max("old_path").alias("old_path"),
        F.max(F.when(F.col("new_path").isNotNull(), F.struct("piece_no", "new_path"))).alias("last_new"),
        F.bool_or("binary").alias("binary"),
        F.sum("hunks").alias("n_hunks"),
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
    )
    new_path = F.coalesce(F.col("last_new.new_path"), F.lit(""))
    named = files.withColumn("path", canonical_path(F.col("old_path"), new_path))
    return named.select(
        "patch_id", "file_seq", "path", extension(F.col("path")).alias("extension"),
        "binary", "n_hunks", "added", "deleted",
    )


def piece_file_stats(pieces: DataFrame) -> DataFrame:
    """The columns of :func:`file_stats` for patches in pieces."""
    # Stored, the few numbers of a piece serve both levels of numbering, and the
    # text is read and cut once.
    files = piece_files(number_pieces(stored(piece_parts(pieces))))
    return files.where((F.col("n_hunks") > 0) | F.col("binary"))
