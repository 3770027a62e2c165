"""Stripped hunks: collapse far context, replace names and literals.

All of it happens inside the row of the hunk.  A rewrite is ``split`` around a
pattern plus the matches themselves, which keeps the order of the passes (a
sentinel that touches a name becomes part of that name in the next pass).
Whole tables of hunks (``strip_files``, ``strip_texts``) are rewritten in Arrow batches by
:mod:`diffloom.operators.strip_text`, which takes a fraction of the time of nested lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions.dialect import SPACE, WORD
from diffloom.functions.rules import (
    COLLAPSE_MARKER,
    KEPT_TYPES,
    KEPT_WORDS,
    PUBLIC_PREFIXES,
    REDACTION_MODES,
)
from diffloom.functions.text import let
from diffloom.operators.context import keep_mask
from diffloom.operators.strip_text import strip_arrays, strip_batches
from diffloom.session import ship_package

FULL, API_SAFE, API_SAFE_COMMENTS, SIGNATURE = REDACTION_MODES

# Possessive repeats keep the Java matcher from recursing on long literals.
_STRING = r"(?d)\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'"
_NUMBER = (
    rf"(?<![{WORD}.])-?\p{{Nd}}+(?:\.\p{{Nd}}+)?(?:[eE][+-]?\p{{Nd}}+)?[fFlLuU]?"
    rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
)
# A number (group 1), or what lies between the places where one can start.
_NUMBER_TOKENS = rf"({_NUMBER})|[^\p{{Nd}}-]+|\p{{Nd}}+|-"
_NAME_TOKENS = rf"[{WORD}]+|[^{WORD}]+"
_NAME = r"\A[A-Za-z_][A-Za-z0-9_]*\z"
_CUT = "\uffff"
_LINE_COMMENT = r"(?d)(?://|#).*"
_BLOCK_COMMENT = r"(?s)/\*.*?\*/|'''.*?'''|\"\"\".*?\"\"\""
_PUBLIC_NAME = (
    r"\A(?:[A-Z][a-z]+(?:[A-Z][a-z]+)*|(?=[^_]*_)[A-Z_][A-Z0-9_]*|(?:"
    + "|".join(PUBLIC_PREFIXES)
    + r").+)\z"
)
_HEAD = rf"\A[+\- ]?[{SPACE}]*"
_KEPT_NUMBERS = ["0", "1", "-1"]


def placeholder(token: Column, path: Column) -> Column:
    """``sym_`` and six hex digits of SHA-256 over path and token."""
    digest = F.sha2(F.concat(path, F.lit("::"), token), 256)
    return F.concat(F.lit("sym_"), F.substring(digest, 1, 6))


def preserved_in_api_safe(token: Column) -> Column:
    return token.isin(*dict.fromkeys(KEPT_WORDS + KEPT_TYPES)) | token.rlike(_PUBLIC_NAME)


def _kept_name(token: Column, mode: str) -> Column:
    sentinel = token.startswith("____") & token.endswith("____")
    if mode in (API_SAFE, API_SAFE_COMMENTS):
        return preserved_in_api_safe(token) | sentinel
    return token.isin(*KEPT_WORDS) | sentinel


def _number_matches(text: Column, pattern: str, label: str, first: Column) -> Column:
    """Replace the k-th match by ``____<label>_<first + k>____``.

    Splitting at a single character needs no regular expression to be compiled
    per row; a text that already holds that character is split at the pattern.
    """
    cut = F.split(F.regexp_replace(text, pattern, _CUT), _CUT, -1)
    pieces = F.when(F.contains(text, F.lit(_CUT)), F.split(text, pattern, -1)).otherwise(cut)
    return F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i == 0, piece).otherwise(
                F.concat(F.lit(f"____{label}_"), (first + i - 1).cast("string"), F.lit("____"), piece)
            ),
        ),
        "",
    )


def _hide(body: Column, path: Column, mode: str) -> Column:
    """Strings, then numbers, then names; sentinels take their final form last."""
    quoted = body.contains('"') | body.contains("'")
    no_strings = F.when(quoted, _number_matches(body, _STRING, "STR", F.lit(1))).otherwise(body)

    def hide_numbers(t: Column) -> Column:
        tokens, numbers = (
            F.regexp_extract_all(t, F.lit(_NUMBER_TOKENS), F.lit(group)) for group in (0, 1)
        )
        hidden = F.zip_with(
            tokens,
            numbers,
            lambda token, number: F.when(
                (number == "") | number.isin(*_KEPT_NUMBERS), token
            ).otherwise(F.lit("____NUM_0____")),
        )
        return F.when(t.rlike(r"\p{Nd}"), F.array_join(hidden, "")).otherwise(t)

    def hide_names(t: Column) -> Column:
        return F.array_join(
            F.transform(
                F.regexp_extract_all(t, F.lit(_NAME_TOKENS), F.lit(0)),
                lambda token: F.when(
                    token.rlike(_NAME) & ~_kept_name(token, mode), placeholder(token, path)
                ).otherwise(token),
            ),
            "",
        )

    def restore(t: Column) -> Column:
        marked = F.regexp_replace(t, r"____STR_\p{Nd}+____", '"<str>"')
        final = F.regexp_replace(marked, r"____NUM_\p{Nd}+____", "<n>")
        return F.when(t.contains("____"), final).otherwise(t)

    return let(hide_names(let(no_strings, hide_numbers)), restore)


def _line_comment(text: Column) -> Column:
    """The first line comment, '' where there is none; most lines have no mark of one."""
    marked = text.contains("//") | text.contains("#")
    return F.when(marked, F.regexp_extract(text, _LINE_COMMENT, 0)).otherwise("")


def _block_marked(text: Column) -> Column:
    """False only where no block comment can be."""
    return text.contains("/*") | text.contains("'''") | text.contains('"""')


def _hide_but_comments(body: Column, path: Column, mode: str) -> Column:
    """Take comments out, hide the rest, put the comments back."""
    line_comment = _line_comment(body)

    def with_line(single: Column) -> Column:
        used = F.when(single == "", 0).otherwise(1)
        code = F.when(single == "", body).otherwise(
            F.regexp_replace(body, _LINE_COMMENT, "____COMMENT_0____")
        )

        def with_blocks(c: Column) -> Column:
            none = F.array().cast("array<string>")
            blocks = F.when(_block_marked(c), F.regexp_extract_all(c, F.lit(_BLOCK_COMMENT), F.lit(0))).otherwise(none)
            singles = F.filter(F.array(single), lambda s: s != "")
            numbered = F.transform(
                F.concat(singles, blocks), lambda s, i: F.struct(i.alias("i"), s.alias("text"))
            )
            code = F.when(_block_marked(c), _number_matches(c, _BLOCK_COMMENT, "COMMENT", used)).otherwise(c)
            hidden = let(code, lambda own: _hide(own, path, mode))
            return F.aggregate(
                numbered,
                hidden,
                lambda acc, n: F.replace(
                    acc, F.concat(F.lit("____COMMENT_"), n["i"], F.lit("____")), n["text"]
                ),
            )

        return let(code, with_blocks)

    return let(line_comment, with_line)


def pseudonymize_line(
    line: Column, path: Column, mode: str = API_SAFE, strict: bool = False
) -> Column:
    """One diff line with its marker and indentation kept and the rest rewritten.

    ``strict`` also hides comments in the comment mode, where by default an
    ``#include`` line or the tail of a URL counts as a comment and stays.
    """
    hide = _hide_but_comments if mode == API_SAFE_COMMENTS and not strict else _hide

    def rewritten(head: Column) -> Column:
        body = F.substring(line, F.length(head) + 1, F.length(line))
        return F.concat(head, let(body, lambda b: hide(b, path, mode)))

    return let(F.regexp_extract(line, _HEAD, 0), rewritten)


def _marker(count: Column, lines: Column, mode: str, template: str) -> Column:
    marker = F.replace(F.lit(template), F.lit("{n}"), count.cast("string"))
    if mode != API_SAFE_COMMENTS:
        return marker
    comments = F.flatten(
        F.transform(
            lines,
            lambda line: F.filter(
                F.array(
                    _line_comment(line),
                    F.when(_block_marked(line), F.regexp_extract(line, _BLOCK_COMMENT, 0)).otherwise(""),
                ),
                lambda c: c != "",
            ),
        )
    )
    return F.array_join(F.concat(F.array(marker), comments), "  ")


def strip_hunk(
    hunk: Column,
    path: Column,
    mode: str = API_SAFE,
    core_context: int = 1,
    strict: bool = False,
    collapse_marker: str = COLLAPSE_MARKER,
) -> Column:
    """Lines of a stripped hunk (``array<string>``), header first and unchanged.

    ``{n}`` in ``collapse_marker`` stands for the number of collapsed lines.  With ``strict`` the function context after the second ``@@`` is cut off.
    """
    marker_mode = API_SAFE if strict else mode

    def build(lines: Column) -> Column:
        has_header = F.get(lines, F.lit(0)).startswith("@@")
        top = F.filter(lines, lambda line, i: (i == 0) & has_header)
        if strict:
            top = F.transform(top, lambda h: F.regexp_replace(h, r"\A(@@ [^@]*@@).*", "$1"))
        rest = F.filter(lines, lambda line, i: (i > 0) | ~has_header)

        def collapse(body: Column) -> Column:
            def merge(keep: Column) -> Column:
                kept = F.filter(
                    F.transform(
                        body,
                        lambda line, i: F.struct(
                            i.alias("pos"),
                            F.when(
                                F.get(keep, i), pseudonymize_line(line, path, mode, strict)
                            ).alias("text"),
                        ),
                    ),
                    lambda r: r["text"].isNotNull(),
                )
                places = F.transform(keep, lambda _, i: i)

                def edge(step: int) -> Column:
                    return F.filter(
                        places,
                        lambda i: ~F.get(keep, i) & F.coalesce(F.get(keep, i + step), F.lit(True)),
                    )

                markers = F.zip_with(
                    edge(-1),
                    edge(1),
                    lambda first, last: F.struct(
                        first.alias("pos"),
                        _marker(
                            last - first + 1,
                            F.slice(body, first + 1, last - first + 1),
                            marker_mode,
                            collapse_marker,
                        ).alias("text"),
                    ),
                )
                return F.transform(F.array_sort(F.concat(kept, markers)), lambda r: r["text"])

            return let(keep_mask(body, core_context), merge)

        return F.concat(top, let(rest, collapse))

    return let(F.split(hunk, "\n", -1), build)


def strip_files(
    files: DataFrame,
    mode: str = API_SAFE,
    core_context: int = 1,
    strict: bool = False,
    collapse_marker: str = COLLAPSE_MARKER,
) -> DataFrame:
    """Stripped lines of the hunks in ``kept_hunks``: ``..., hunk_seq, ord, text``.

    ``hunk_seq`` counts the kept hunks of the file; the placeholder of a token
    depends on the path only, so all hunks of a file agree on it.
    """
    ship_package(files.sparkSession)
    kinds = dict(files.dtypes)
    rows = files.select("patch_id", "file_seq", "path", "kept_hunks")
    return rows.mapInArrow(
        strip_batches(mode, core_context, strict, collapse_marker),
        f"patch_id {kinds['patch_id']}, file_seq {kinds['file_seq']}, hunk_seq int, ord int, text string",
    )


def strip_texts(
    hunks: Column,
    path: Column,
    mode: str = API_SAFE,
    core_context: int = 1,
    strict: bool = False,
    collapse_marker: str = COLLAPSE_MARKER,
) -> Column:
    """Each of an array of hunks as :func:`strip_hunk` has it, its lines joined."""
    ship_package(SparkSession.active())
    return F.arrow_udf(strip_arrays(mode, core_context, strict, collapse_marker), "array<string>")(hunks, path)
