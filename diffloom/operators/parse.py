"""Patch text to file, hunk and line tables.

A patch is one row, so its structure can be found inside the row: the text is
cut at file headers, each piece at hunk headers, each hunk at line ends.  The
only operators are projections and generators; nothing is shuffled or sorted,
and numbering comes from the position in the array that is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions.text import (
    ADD_MARK,
    CHANGED_MARK,
    DEL_MARK,
    canonical_path,
    computed,
    count_changed,
    extension,
    join_lines,
    let,
    line_kind,
    pick,
    unify_newlines,
    without_last_newline,
)

HUNK_HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
CUT_FILES = r"\n(?=--- )"
CUT_HUNKS = r"\n(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
NEW_PATH_LINE = r"(?md)^\+\+\+ ([^\t\n]*)"
BINARY_LINE = r"(?md)^Binary files"
CONSUMED = r"(?d)\n(?:\+\+\+ |Binary files).*"


def parse_patches(patches: DataFrame) -> DataFrame:
    """``(patch_id, content)`` to one row per file entry.

    Output: ``patch_id, file_seq, old_path, new_path, path, extension, binary,
    hunks array<string>, n_hunks, body, added, deleted``.  A hunk is its text
    with the ``@@`` header as first line; ``body`` is all hunks joined.
    ``path_repeats`` tells inside the patch row whether the path has other
    entries, so that later steps exchange those only; it is computed where used.
    """
    text = without_last_newline(F.concat(F.lit("\n"), unify_newlines(F.col("content"))))
    # The outer generator keeps Catalyst from adding a size() filter that would
    # cut every text twice; element 0 is what precedes the first file header.
    cut = patches.select("patch_id", F.split(text, CUT_FILES, -1).alias("_pieces"))
    # Heads first: paths are then worked out from a few lines and not from whole pieces.
    heads = F.transform("_pieces", path_lines)
    paths = F.transform(heads, lambda head: canonical_path(*_paths_in(head)))
    # Below the generator, so that it is evaluated once per patch.
    segments = (
        cut.select("patch_id", "_pieces", _repeated(paths).alias("_repeated"))
        .select("patch_id", "_repeated", F.posexplode_outer("_pieces").alias("file_seq", "segment"))
        .where("file_seq > 0")
    )
    seg = F.col("segment")
    marked = segments.select("*", path_lines(seg).alias("_head"), _stray_headers(seg).alias("_strays"))
    old_path, new_path = _paths_in(F.col("_head"))
    entries = computed(
        marked,
        old_path=old_path,
        new_path=new_path,
        binary=F.contains(seg, F.lit("\nBinary files")),
        hunks=_hunk_texts(F.when(F.col("_strays"), F.regexp_replace(seg, CONSUMED, "")).otherwise(seg)),
    )
    return finish_file_diffs(entries)


def _stray_headers(segment: Column) -> Column:
    """True if header lines are inside of hunks, which is rare; only then is the whole text searched.

    Also true of some other segments, binary ones among them, whose results do not depend on it.
    Only bytes are compared, as this runs over every text.
    """
    second = F.octet_length(F.substring_index(segment, "\n+++ ", 2)) < F.octet_length(segment)
    head = F.substring_index(segment, "\n@@ ", 1)
    late = F.contains(segment, F.lit("\n+++ ")) & ~F.contains(head, F.lit("\n+++ "))
    return second | late | F.contains(segment, F.lit("\nBinary files"))


def path_lines(segment: Column) -> Column:
    """The part of a segment that names its paths: mostly what precedes the first hunk."""
    return F.when(_stray_headers(segment), segment).otherwise(F.substring_index(segment, "\n@@ ", 1))


def header_paths(segment: Column) -> tuple[Column, Column]:
    """Old and new path of the text from one file header to the next."""
    return _paths_in(path_lines(segment))


def _paths_in(head: Column) -> tuple[Column, Column]:
    new_paths = F.regexp_extract_all(head, F.lit(NEW_PATH_LINE), F.lit(1))
    return (
        F.regexp_extract(head, r"\A--- ([^\t\n]*)", 1),
        F.coalesce(F.try_element_at(new_paths, F.lit(-1)), F.lit("")),
    )


def _repeated(paths: Column) -> Column:
    """Paths of the files of a patch that occur more than once; element 0 is no file."""
    files = F.array_sort(F.slice(paths, 2, F.greatest(F.size(paths) - 1, F.lit(0))))
    return let(
        files, lambda own: F.filter(own, lambda p, i: (i > 0) & (p == F.get(own, i - 1)))
    )


def finish_file_diffs(entries: DataFrame) -> DataFrame:
    """Add the derived columns to ``patch_id, file_seq, old_path, new_path, binary, hunks``.

    ``path_repeats`` is null (not known) unless the entries say which paths repeat.
    """
    named = entries.withColumn("path", canonical_path(F.col("old_path"), F.col("new_path")))
    known = "_repeated" in entries.columns
    repeats = F.array_contains("_repeated", F.col("path")) if known else F.lit(None).cast("boolean")
    body = named.select(
        "patch_id",
        "file_seq",
        "old_path",
        "new_path",
        "path",
        extension(F.col("path")).alias("extension"),
        "binary",
        "hunks",
        F.size("hunks").alias("n_hunks"),
        join_lines(F.col("hunks")).alias("body"),
        repeats.alias("path_repeats"),
    )
    return body.select(
        *[c for c in body.columns if c != "path_repeats"],
        count_changed(F.col("body"), "+").alias("added"),
        count_changed(F.col("body"), "-").alias("deleted"),
        "path_repeats",
    )


def _hunk_texts(segment: Column) -> Column:
    pieces = F.split(segment, CUT_HUNKS, -1)
    return F.filter(pieces, lambda _, i: i > 0)


def changed_only(files: DataFrame) -> DataFrame:
    """Drop identical entries: no hunk and not binary."""
    return files.where((F.col("n_hunks") > 0) | F.col("binary"))


def text_files(files: DataFrame) -> DataFrame:
    """Entries that analysis looks at: not binary and with at least one hunk."""
    return files.where(~F.col("binary") & (F.col("n_hunks") > 0))


def hunk_table(files: DataFrame) -> DataFrame:
    """One row per hunk with its header numbers and line counts."""
    rows = files.select(
        "patch_id",
        "file_seq",
        "path",
        "extension",
        F.posexplode_outer("hunks").alias("pos", "text"),
    ).where("pos is not null")
    text = F.col("text")
    first_line = F.substring_index(text, "\n", 1)

    def number(group: int) -> Column:
        return F.regexp_extract(first_line, rf"\A{HUNK_HEADER}", group).try_cast("int")

    # A hunk without a header stands for the line counts of a compare report.
    has_header = first_line.rlike(rf"\A{HUNK_HEADER}")

    def count(group: int, placeholder: str) -> Column:
        stated = F.regexp_extract(text, rf"(?m)^{placeholder}$", 1).try_cast("int")
        return F.when(has_header, F.coalesce(number(group), F.lit(1))).otherwise(
            F.coalesce(stated, F.lit(0))
        )

    def start(group: int) -> Column:
        return F.when(has_header, number(group)).otherwise(F.lit(1))

    return rows.select(
        "patch_id",
        "file_seq",
        (F.col("pos") + 1).alias("hunk_seq"),
        "path",
        "extension",
        start(1).alias("old_start"),
        count(2, r"-\[(-?\d+) lines in old file\]").alias("old_count"),
        start(3).alias("new_start"),
        count(4, r"\+\[(-?\d+) lines in new file\]").alias("new_count"),
        count_changed(text, "+").alias("added"),
        count_changed(text, "-").alias("deleted"),
        "text",
    )


def diff_lines(files: DataFrame) -> DataFrame:
    """One row per hunk line; line 0 of a hunk is its header."""
    hunks = files.select(
        "patch_id", "file_seq", F.posexplode_outer("hunks").alias("pos", "hunk")
    ).where("pos is not null")
    lines = hunks.select(
        "patch_id",
        "file_seq",
        (F.col("pos") + 1).alias("hunk_seq"),
        F.posexplode_outer(F.split("hunk", "\n", -1)).alias("line_no", "text"),
    )
    return lines.withColumn("kind", line_kind(F.col("text"), F.col("line_no") == 0))


def added_text(body: Column) -> Column:
    return join_lines(pick(body, ADD_MARK))


def removed_text(body: Column) -> Column:
    return join_lines(pick(body, DEL_MARK))


def changed_text(body: Column) -> Column:
    return join_lines(pick(body, CHANGED_MARK))


def post_image(body: Column) -> Column:
    """Added and context lines without their marker."""
    return join_lines(pick(body, rf"(?:{ADD_MARK}| )"))
