"""Compare two snapshots of a file tree, or pairs of files.

Digests of the texts are joined first.  Only pairs that really differ fetch
their contents, and only pairs with text on both sides reach Python, where the
standard library computes the line differences of one pair at a time.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions.rules import SNAPSHOT_CONTEXT, TEXT_EXTENSIONS
from diffloom.functions.text import extension, join_lines, split_lines
from diffloom.operators.parse import finish_file_diffs, parse_patches
from diffloom.sources.file_tree import list_files, read_files, with_contents, without_globs
from diffloom.storage import numbered, stored

NO_FILE = "/dev/null"
#: Fixed value: how much of a file of unknown type decides whether it is text.
TEXT_PROBE = 512
#: All that ends a line for ``str.splitlines``.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def read_snapshot(
    spark: SparkSession, folder: str, exclude: Iterable[str] = (), hidden: bool = True
) -> DataFrame:
    """``path`` (relative, with /) and ``content`` of all files under ``folder``.

    Files that match a glob of ``exclude`` are not read.  ``hidden = False`` uses Spark's own
    listing, which leaves out names that start with a dot or underscore, for stores
    that only Spark's readers can open.
    """
    if hidden:
        return read_files(list_files(spark, folder, exclude), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.split(":", 1)[-1].strip("/") + "/"
    inner = F.regexp_replace("path", r"\A[A-Za-z0-9+.-]+:/*", "")
    below = F.expr("substring(inner, instr(inner, base) + length(base))")
    read = files.select(inner.alias("inner"), F.lit(base).alias("base"), "content").select(
        below.alias("path"), "content"
    )
    return without_globs(read, exclude)


def exclude_paths(snapshot: DataFrame, globs: Iterable[str]) -> DataFrame:
    """Drop paths that match a glob; ``*`` also matches ``/``."""
    return without_globs(snapshot, globs)


def is_text(path: Column, content: Column, probe_bytes: int | None = TEXT_PROBE) -> Column:
    """Known text extension, or the first ``probe_bytes`` (None: all) are UTF-8.

    The probe may cut the last character; an incomplete tail of up to three
    bytes does not make a file binary.
    """
    known = F.lower(extension(path)).isin(*TEXT_EXTENSIONS)
    if probe_bytes is None:
        return known | F.is_valid_utf8(content.cast("string"))
    probe = F.substring(content, 1, probe_bytes)
    valid = F.is_valid_utf8(probe.cast("string"))
    tail = F.hex(F.substring(content, probe_bytes - 2, 3))
    longer = F.length(content) > probe_bytes
    for cut, lead in (
        (1, "(?:C[2-9A-F]|D.|E.|F[0-4])$"),
        (2, "(?:E.|F[0-4])[89AB].$"),
        (3, "F[0-4](?:[89AB].){2}$"),
    ):
        shorter = F.substring(content, 1, probe_bytes - cut).cast("string")
        valid = valid | (longer & tail.rlike(lead) & F.is_valid_utf8(shorter))
    return known | valid


def _decoded(content: Column) -> Column:
    """Text with CR and CRLF as LF and bad bytes as U+FFFD."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\r", "\n")


def _digested(snapshot: DataFrame, side: str, probe_bytes: int | None) -> DataFrame:
    text = is_text(F.col("path"), F.col("content"), probe_bytes)
    # One digest for the decoded text and one for the bytes of binary files.
    digest = F.when(F.col("is_text"), F.sha2(_decoded(F.col("content")), 256)).otherwise(
        F.sha2("content", 256)
    )
    return snapshot.select("path", "content", text.alias("is_text")).select(
        "path",
        F.lit(True).alias(f"in_{side}"),
        F.col("is_text").alias(f"{side}_text"),
        digest.alias(f"{side}_digest"),
    )


def snapshot_status(
    left: DataFrame, right: DataFrame, probe_bytes: int | None = TEXT_PROBE
) -> DataFrame:
    """``path, status, binary, bytes_equal`` of every path of either snapshot.

    ``status`` is added, removed, changed or equal.  A pair with a binary side is
    reported as changed even when the bytes agree, which ``bytes_equal`` tells.
    """
    old, new = (_digested(t, side, probe_bytes) for t, side in ((left, "left"), (right, "right")))
    pairs = old.join(new, "path", "full_outer")
    here, there = F.col("in_left").isNotNull(), F.col("in_right").isNotNull()
    same = F.coalesce(F.col("left_digest") == F.col("right_digest"), F.lit(False))
    binary = ~F.coalesce("left_text", F.lit(True)) | ~F.coalesce("right_text", F.lit(True))
    status = (
        F.when(~here, "added").when(~there, "removed").when(binary | ~same, "changed").otherwise("equal")
    )
    return pairs.select(
        "path", status.alias("status"), binary.alias("binary"), (same & binary).alias("bytes_equal")
    )


def _changed(left: DataFrame, right: DataFrame, probe_bytes: int | None) -> DataFrame:
    status = snapshot_status(left, right, probe_bytes)
    return stored(status.where("status <> 'equal'").select("path", "status", "binary"))


def _named_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "path",
        F.when(F.col("status") == "added", NO_FILE).otherwise(F.concat(F.lit("a/"), "path")).alias("old_path"),
        F.when(F.col("status") == "removed", NO_FILE).otherwise(F.concat(F.lit("b/"), "path")).alias("new_path"),
        "status",
        "binary",
        "left_doc",
        "right_doc",
    )


def changed_pairs(
    left: DataFrame, right: DataFrame, probe_bytes: int | None = TEXT_PROBE
) -> DataFrame:
    """Text of the pairs that need a line difference, one row per path.

    An empty file on one side only is no change: it has no lines.
    """
    # Stored, the changed paths have a known size: when they are few, Catalyst
    # broadcasts them and no content of an equal file is shuffled.
    changed = _changed(left, right, probe_bytes)
    pairs = changed
    # Binary files are reported by name, so their contents stay where they are.
    differing = changed.where("not binary").select("path")
    for side, table in (("left", left), ("right", right)):
        texts = table.select("path", _decoded(F.col("content")).alias(f"{side}_doc"))
        wanted = texts.join(differing, "path", "left_semi")
        pairs = pairs.join(wanted, "path", "left")
    return _named_pairs(pairs)


def changed_folder_pairs(
    spark: SparkSession, left: str, right: str, exclude: Iterable[str] = (),
    probe_bytes: int | None = TEXT_PROBE,
) -> DataFrame:
    """:func:`changed_pairs` of two folders, whose files can be read again by name.

    Only digests are exchanged.  Both files of a pair that changed are then read by the task
    that has its path, so no content passes an exchange, of equal files or others.
    """
    globs = list(exclude)
    sides = {"left": left, "right": right}
    # One listing a side serves both steps.
    lists = {side: stored(list_files(spark, folder, globs)) for side, folder in sides.items()}
    changed = _changed(*(read_files(lists[side], sides[side]) for side in sides), probe_bytes)
    for side in sides:
        here = lists[side].select("path", F.col("length").alias(f"{side}_length"))
        changed = changed.join(here, "path", "left")
    bytes_ = sum(F.coalesce(f"{side}_length", F.lit(0)) for side in sides)
    there = {side: ~F.col("binary") & F.col(f"{side}_length").isNotNull() for side in sides}
    rows = changed.select(
        "path", "status", "binary", F.when(F.col("binary"), 0).otherwise(bytes_).alias("length"),
        *[flag.alias(f"in_{side}") for side, flag in there.items()],
    )
    read = with_contents(rows, {f"{side}_bytes": (folder, f"in_{side}") for side, folder in sides.items()})
    docs = {f"{side}_doc": _decoded(F.col(f"{side}_bytes")) for side in sides}
    return _named_pairs(read.withColumns(docs))


def _one_sided_patch() -> Column:
    """Patch of a file that exists on one side only; null when it has no lines."""
    doc = F.coalesce("right_doc", "left_doc")
    sign = F.when(F.col("status") == "added", "+").otherwise("-")
    lines = split_lines(doc)
    count = F.size(lines)
    span = F.when(count == 1, F.lit("1")).otherwise(F.concat(F.lit("1,"), count))
    header = F.when(
        F.col("status") == "added", F.concat(F.lit("@@ -0,0 +"), span, F.lit(" @@"))
    ).otherwise(F.concat(F.lit("@@ -"), span, F.lit(" +0,0 @@")))
    body = join_lines(F.transform(lines, lambda line: F.concat(sign, line)))
    names = [F.concat(F.lit("--- "), "old_path"), F.concat(F.lit("+++ "), "new_path")]
    return F.when(count > 0, F.concat_ws("\n", *names, header, body))


def _line_differ():
    """Function for ``mapInPandas``; a closure, so workers need not have this package."""

    ends = LINE_ENDS

    def line_diffs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Unified diff of each pair; a last line without an end gets LF."""
        for batch in batches:
            patches = []
            for old_path, new_path, old, new in zip(
                batch.old_path, batch.new_path, batch.left_doc, batch.right_doc
            ):
                lines = difflib.unified_diff(
                    old.splitlines(keepends=True),
                    new.splitlines(keepends=True),
                    fromfile=old_path,
                    tofile=new_path,
                    n=SNAPSHOT_CONTEXT,
                )
                patches.append("".join(x if x[-1] in ends else x + "\n" for x in lines))
            yield pd.DataFrame({"patch_id": batch.path, "content": patches})

    return line_diffs


def pair_patches(pairs: DataFrame) -> DataFrame:
    """``patch_id`` (the path) and ``content`` for all text pairs that differ."""
    texts = pairs.where("not binary")
    one_sided = texts.where("status <> 'changed'").select(
        F.col("path").alias("patch_id"), _one_sided_patch().alias("content")
    ).where("content is not null")
    both = texts.where("status = 'changed'").select("path", "old_path", "new_path", "left_doc", "right_doc")
    diffs = both.mapInPandas(_line_differ(), "patch_id string, content string")
    return one_sided.unionByName(diffs.where("content <> ''"))


def _binary_entries(pairs: DataFrame) -> DataFrame:
    return finish_file_diffs(
        pairs.where("binary").select(
            F.col("path").alias("patch_id"),
            F.lit(1).alias("file_seq"),
            "old_path",
            "new_path",
            F.lit(True).alias("binary"),
            F.array().cast("array<string>").alias("hunks"),
        )
    )


def _compared(pairs: DataFrame) -> DataFrame:
    # Stored, the contents of changed files are fetched once for all three branches.
    pairs = stored(pairs)
    return parse_patches(pair_patches(pairs)).unionByName(_binary_entries(pairs))


def compare_snapshots(
    left: DataFrame, right: DataFrame, exclude: list[str] | None = None,
    probe_bytes: int | None = TEXT_PROBE,
) -> DataFrame:
    """File table of the differences; ``patch_id`` is the relative path.

    Ordering by ``patch_id, file_seq`` gives the order of the change set;
    :func:`as_change_set` turns it into one patch.
    """
    left, right = (exclude_paths(side, exclude or []) for side in (left, right))
    return _compared(changed_pairs(left, right, probe_bytes))


def compare_folders(
    spark: SparkSession, left: str, right: str, exclude: Iterable[str] = (),
    probe_bytes: int | None = TEXT_PROBE,
) -> DataFrame:
    """:func:`compare_snapshots` of two folders; what ``exclude`` names is not read."""
    return _compared(changed_folder_pairs(spark, left, right, exclude, probe_bytes))


def as_change_set(files: DataFrame, name: str) -> DataFrame:
    """All files as one patch called ``name``, numbered in path order.

    Facts that concern the whole comparison, such as imports that moved from one
    file to another, need this view.
    """
    placed = numbered(files.withColumnRenamed("file_seq", "entry"), "patch_id", "entry")
    columns = {
        "patch_id": F.lit(name),
        "file_seq": F.col("number") + 1,
        "path_repeats": F.lit(None).cast("boolean"),  # known within one path only
    }
    return placed.select(*[columns.get(c, F.col(c)).alias(c) for c in files.columns])


def compare_file_pairs(pairs: DataFrame, probe_bytes: int | None = TEXT_PROBE) -> DataFrame:
    """Compare explicit pairs ``left_path, right_path, left, right`` (binary).

    Equal pairs stay as identical entries (no hunks), binary pairs as binary.
    """
    text = [is_text(F.col(f"{side}_path"), F.col(side), probe_bytes) for side in ("left", "right")]
    binary = ~(text[0] & text[1])
    docs = pairs.select(
        F.concat_ws(" | ", "left_path", "right_path").alias("path"),
        F.concat(F.lit("a/"), "left_path").alias("old_path"),
        F.concat(F.lit("b/"), "right_path").alias("new_path"),
        binary.alias("binary"),
        _decoded(F.col("left")).alias("left_doc"),
        _decoded(F.col("right")).alias("right_doc"),
    )
    differs = ~F.col("binary") & (F.col("left_doc") != F.col("right_doc"))
    texts = docs.where(differs).withColumn("status", F.lit("changed"))
    same = docs.where(~F.col("binary") & (F.col("left_doc") == F.col("right_doc"))).select(
        F.col("path").alias("patch_id"),
        F.lit(1).alias("file_seq"),
        "old_path",
        "new_path",
        F.lit(False).alias("binary"),
        F.array().cast("array<string>").alias("hunks"),
    )
    entries = finish_file_diffs(same).unionByName(_binary_entries(docs))
    return parse_patches(pair_patches(texts)).unionByName(entries)
