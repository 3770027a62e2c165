"""Column helpers for lines, paths and ordered pieces of text."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions.dialect import SPACE_CHARS, java_regex, required_words

# A line is changed when its marker is + or -, unless the marker is tripled.
ADD_MARK = r"\+(?!\+\+)"
DEL_MARK = r"-(?!--)"
CHANGED_MARK = rf"(?:{ADD_MARK}|{DEL_MARK})"
# Line separators of ``str.splitlines`` besides LF and CRLF.
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it by name inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(table: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Catalyst pushes a filter below a projection and repeats the expressions it
    refers to.  A generator that yields one row stops that, which pays off for
    columns that cut or filter whole texts.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return table.select("*", F.inline_outer(F.array(row)))


def may_match(text: Column, pattern: str, flags: str = "") -> Column:
    """False only where ``pattern`` cannot match, judged by plain literals."""
    words = required_words(pattern)
    if words is None:
        return F.lit(True)
    if "i" in flags:
        # Same folding as case-insensitive matching: long s is an s.
        text, words = F.lower(F.upper(text)), [w.lower() for w in words]
    return reduce(or_, [F.contains(text, F.lit(w)) for w in dict.fromkeys(words)])


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return may_match(text, pattern, flags) & text.rlike(java_regex(pattern, flags))


def find_all(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    """All matches of a rule, an empty array where it cannot match."""
    found = F.regexp_extract_all(text, F.lit(java_regex(pattern, flags)), F.lit(group))
    none = F.array().cast("array<string>")
    return F.when(may_match(text, pattern, flags), found).otherwise(none)


def unify_newlines(text: Column) -> Column:
    """Turn every line separator known to ``str.splitlines`` into LF."""
    lone = OTHER_LINE_ENDS
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    # Most texts have no other separator, and searches for bytes are much cheaper than a translation.
    others = reduce(or_, [F.contains(plain, F.lit(c)) for c in lone])
    return F.when(others, F.translate(plain, lone, "\n" * len(lone))).otherwise(plain)


def without_last_newline(text: Column) -> Column:
    """The text without one LF at its end; other texts are not searched."""
    return F.when(text.endswith("\n"), F.regexp_replace(text, r"\n\z", "")).otherwise(text)


def split_lines(text: Column) -> Column:
    """``str.splitlines``: no element for the text after the last separator."""
    body = without_last_newline(unify_newlines(text))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, "\n", -1)
    )


def strip(text: Column) -> Column:
    """``str.strip`` for white space."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def pick(text: Column, mark: str) -> Column:
    """Texts (marker removed) of the lines of ``text`` that start with ``mark``."""
    return F.regexp_extract_all(text, F.lit(rf"(?md)^{mark}(.*)$"), F.lit(1))


def _count_starts(text: Column, start: str) -> Column:
    """Number of lines that begin with ``start``, by plain substring search."""
    lines = F.concat(F.lit("\n"), text)
    rest = F.replace(lines, F.lit("\n" + start), F.lit(""))
    return (F.octet_length(lines) - F.octet_length(rest)) / F.lit(1 + len(start))


def count_changed(text: Column, sign: str) -> Column:
    """Lines of a hunk that start with the sign, but not with three of it."""
    return (_count_starts(text, sign) - _count_starts(text, sign * 3)).cast("int")


def line_kind(line: Column, is_first: Column) -> Column:
    return (
        F.when(is_first & line.startswith("@@"), "header")
        .when(line.rlike(rf"\A{ADD_MARK}"), "add")
        .when(line.rlike(rf"\A{DEL_MARK}"), "del")
        .when(line.startswith(" "), "ctx")
        .otherwise("other")
    )


def canonical_path(old_path: Column, new_path: Column) -> Column:
    """New path unless it is /dev/null; one leading b/, then one a/, removed."""
    chosen = F.when(new_path != "/dev/null", new_path).otherwise(old_path)
    return F.regexp_replace(F.regexp_replace(chosen, r"\Ab/", ""), r"\Aa/", "")


def extension(path: Column) -> Column:
    """Lower-case last suffix of the base name; none for dot-files."""
    base = F.substring_index(F.regexp_replace(path, r"/+\z", ""), "/", -1)
    return F.lower(F.regexp_extract(base, r"(?s)\A.+\.([^.]+)\z", 1))


def subsystem(path: Column) -> Column:
    """First directory that is not a common root folder, else the first part."""
    parts = F.split(F.translate(path, "\\", "/"), "/", -1)

    def first_named(p: Column) -> Column:
        folders = F.slice(p, F.lit(1), F.size(p) - 1)
        named = F.filter(folders, lambda d: ~F.lower(d).isin(*ROOT_FOLDERS))
        return F.coalesce(F.get(named, F.lit(0)), F.get(p, F.lit(0)))

    return let(parts, first_named)


# Folders that do not name a subsystem.
ROOT_FOLDERS = ["src", "lib", "include", "source", "app", ".", ""]


def first_match(rules: list[tuple[str, Column]]) -> Column:
    """Label of the first rule whose condition holds, else null."""
    chain = F.when(rules[0][1], F.lit(rules[0][0]))
    for label, condition in rules[1:]:
        chain = chain.when(condition, F.lit(label))
    return chain
