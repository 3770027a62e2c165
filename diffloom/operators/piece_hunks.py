"""Hunk, token and symbol results of patches that come in numbered pieces.

A hunk may begin in one piece and end in another, so what a piece knows of it is kept as a
state that can be merged in any order, a row of numbers per piece and hunk:

* the multiset of token lists of added against removed lines, as sums of the four 32-bit
  numbers of a hash of each line, plus for added and minus for removed ones.  Equal multisets have sums of
  zero; others have them with a chance of about 2 ** -128;
* for every comment dialect, whether all changed lines seen are comments or blank.  Which
  dialect counts is known once the file's path is;
* characters, lines added and removed.

Hunks are described in Arrow batches (:mod:`diffloom.operators.piece_text`) within the task that reads them, so only these rows are exchanged, and text never
is.  Files and hunks are numbered as in :mod:`diffloom.operators.pieces`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.rules import (
    COMMENT_STARTS,
    COMMENT_STARTS_OTHER,
    SYMBOL_EXTENSIONS,
    SYMBOL_PATTERNS,
)
from diffloom.operators.piece_text import LANES, describe_batches, symbol_batches
from diffloom.operators.pieces import number_pieces, part_sums, piece_files
from diffloom.operators.statistics import chars_to_tokens
from diffloom.operators.symbols import needs_parenthesis
from diffloom.session import ship_package
from diffloom.storage import stored

PART = ["patch_id", "piece_no", "part"]
SUMS = [f"sum_{lane}" for lane in range(LANES)]
FILE = ["patch_id", "file_seq"]


def _dialects() -> dict[str, list[str]]:
    return {**COMMENT_STARTS, "": COMMENT_STARTS_OTHER}


def _all_comments(dialect: str) -> str:
    return f"comments_{dialect or 'other'}"


def _in_arrow(pieces: DataFrame, work, columns: str) -> DataFrame:
    """``patch_id, piece_no`` and the columns that ``work`` makes of each piece."""
    ship_package(pieces.sparkSession)
    kinds = dict(pieces.dtypes)
    keys = f"patch_id {kinds['patch_id']}, piece_no {kinds['piece_no']}"
    return pieces.select("patch_id", "piece_no", "content").mapInArrow(work, f"{keys}, {columns}")


def describe_pieces(pieces: DataFrame) -> DataFrame:
    """``patch_id, piece_no, parts, states`` of every piece: the parts of files in it (as
    :func:`diffloom.operators.pieces.piece_parts` has them) and the state of its hunks; hunk 0 is the
    rest of one begun earlier."""
    names = [_all_comments(dialect) for dialect in _dialects()]
    counts = ("part", "hunk", "added", "deleted", "lines", "chars", *SUMS)
    state = ", ".join([*[f"{c}: bigint" for c in counts], *[f"{name}: boolean" for name in names]])
    part = (
        "part: bigint, old_path: string, new_path: string, binary: boolean, hunks: bigint, "
        "added: bigint, deleted: bigint, head_added: bigint, head_deleted: bigint"
    )
    work = describe_batches([*_dialects().values()], names)
    return _in_arrow(pieces, work, f"parts array<struct<{part}>>, states array<struct<{state}>>")


def _placed(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbers of file and hunk for rows ``(patch_id, piece_no, part, hunk, ...)``; lines of no hunk go."""
    own = numbers.select("patch_id", "piece_no", "files_before", "open_hunks")
    placed = rows.join(own, ["patch_id", "piece_no"]).select(
        "patch_id",
        (F.col("files_before") + F.col("part")).alias("file_seq"),
        (F.col("hunk") + F.when(F.col("part") == 0, F.col("open_hunks")).otherwise(0)).alias("hunk_seq"),
        *[c for c in rows.columns if c not in ("patch_id", "part", "hunk")],
    )
    return placed.where("file_seq > 0 and hunk_seq > 0")


class Pieces:
    """Numbering of pieces and the state of their hunks, each worked out once and stored."""

    def __init__(self, pieces: DataFrame) -> None:
        self.pieces = pieces
        # One pass over the text gives the numbers of parts and hunks.
        self.described = stored(describe_pieces(pieces))
        self.parts = part_sums(self.described)
        self.numbers = stored(number_pieces(self.parts))
        self.files = stored(piece_files(self.numbers))
        self._hunks: DataFrame | None = None

    @property
    def hunks(self) -> DataFrame:
        """``patch_id, file_seq, hunk_seq, path, extension, binary, added, deleted, chars, ws_only, comment_only``."""
        if self._hunks is None:
            states = self.described.select("patch_id", "piece_no", F.inline("states"))
            merged = _placed(states, self.numbers).groupBy(*FILE, "hunk_seq").agg(
                *[F.sum(c).alias(c) for c in ("added", "deleted", "lines", "chars", *SUMS)],
                *[F.bool_and(_all_comments(d)).alias(_all_comments(d)) for d in _dialects()],
            )
            files = self.files.select(*FILE, "path", "extension", "binary")
            changed = F.col("added") + F.col("deleted") > 0
            balanced = reduce(Column.__and__, [F.col(c) == 0 for c in SUMS], F.col("added") == F.col("deleted"))
            clean = F.col(_all_comments(""))
            for dialect in COMMENT_STARTS:
                clean = F.when(F.col("extension") == dialect, F.col(_all_comments(dialect))).otherwise(clean)
            self._hunks = stored(
                merged.join(files, FILE).select(
                    *FILE, "hunk_seq", "path", "extension", "binary", "added", "deleted",
                    # Lines are joined by one character.
                    (F.col("chars") + F.col("lines") - 1).alias("chars"),
                    (changed & balanced).alias("ws_only"),
                    (changed & clean).alias("comment_only"),
                )
            )
        return self._hunks

    def kept_hunks(self, skip_whitespace: bool = True, skip_comments: bool = True) -> DataFrame:
        """Hunks without the noise the switches name."""
        noise = [F.col(c) for c, skip in (("ws_only", skip_whitespace), ("comment_only", skip_comments)) if skip]
        return self.hunks.where(~reduce(Column.__or__, noise)) if noise else self.hunks

    def meaningful(self, skip_whitespace: bool = True, skip_comments: bool = True) -> DataFrame:
        """``patch_id, file_seq, n_hunks, n_kept`` of files that have a hunk or are binary."""
        kept = self.kept_hunks(skip_whitespace, skip_comments).groupBy(*FILE).agg(F.count("*").alias("n_kept"))
        changed = self.files.where((F.col("n_hunks") > 0) | F.col("binary"))
        return changed.join(kept, FILE, "left").select(
            *FILE, "n_hunks", F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept")
        )

    def file_tokens(self, skip_whitespace: bool = True, skip_comments: bool = True) -> DataFrame:
        """The columns of :func:`diffloom.operators.statistics.file_tokens`."""
        kept = self.kept_hunks(skip_whitespace, skip_comments).where("not binary")
        files = kept.groupBy(*FILE).agg(
            F.first("path").alias("path"), (F.sum("chars") + F.count("*") - 1).alias("chars")
        )
        return files.withColumn("tokens", chars_to_tokens(F.col("chars")))

    def symbols(self) -> DataFrame:
        """The columns of :func:`diffloom.operators.symbols.symbol_table`.

        A file's language is known in the piece that has its header, unless the file is cut;
        in the first and last part of a piece the rules of all languages are tried, and those of
        the file's language are chosen when the numbers are joined.
        """
        guards = {p: needs_parenthesis(p) for patterns in SYMBOL_PATTERNS.values() for p in patterns}
        # A symbol once for each hunk and piece leaves the task that found it.
        found = _in_arrow(
            self.pieces, symbol_batches(guards), "part bigint, hunk bigint, language string, symbol string, line_no int, rule int"
        )
        firsts = found.select(*PART, "hunk", "language", "symbol", F.struct("line_no", "rule").alias("at"))
        language = F.create_map(
            *[F.lit(x) for name, known in SYMBOL_EXTENSIONS.items() for e in known for x in (e, name)]
        )
        kept = self.kept_hunks().select(
            *FILE, "hunk_seq", F.try_element_at(language, F.col("extension")).alias("language")
        )
        placed = _placed(firsts, self.numbers).join(kept, [*FILE, "hunk_seq", "language"])
        names = placed.groupBy(*FILE, "symbol").agg(F.min(F.struct("hunk_seq", "piece_no", "at")).alias("first"))
        order = Window.partitionBy(*FILE).orderBy("first")
        return names.select(*FILE, F.row_number().over(order).alias("ord"), "symbol")
