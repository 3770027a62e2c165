"""Names of functions and types touched by a change."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions.dialect import java_regex, required_words
from diffloom.functions.rules import SYMBOL_EXTENSIONS, SYMBOL_PATTERNS
from diffloom.functions.text import computed, join_lines
from diffloom.operators.hunk_filters import meaningful
from diffloom.operators.parse import changed_only


def needs_parenthesis(pattern: str) -> bool:
    """Every match has a ``(``: the pattern has one outside of groups and alternatives."""
    depth, found = 0, False
    tokens = re.findall(r"\\.|\[\^?[^\]]*\]|.", pattern, re.S)
    for tok, following in zip(tokens, [*tokens[1:], ""]):
        depth += (tok == "(") - (tok == ")")
        if depth == 0 and tok == "|":
            return False
        found = found or (depth == 0 and tok == r"\(" and following not in ("?", "*", "{"))
    return found


def _guarded(line: Column, pattern: str, name: Column) -> Column:
    """Try the pattern only on lines with a literal that each of its matches has."""
    words = required_words(pattern) or (["("] if needs_parenthesis(pattern) else [])
    if not words:
        return name
    return F.when(reduce(or_, [line.contains(w) for w in words]), name).otherwise("")


def line_names(line: Column, patterns: list[str]) -> Column:
    """First non-empty group of each pattern on one line, '' where there is none."""
    found = []
    for pattern in patterns:
        regex = java_regex(pattern)
        name = F.regexp_extract(line, regex, 1)
        if pattern.count(r"(\w+)") > 1:
            name = F.coalesce(F.nullif(name, F.lit("")), F.regexp_extract(line, regex, 2))
        found.append(_guarded(line, pattern, name))
    return F.array(*found)


def symbol_list(kept_hunks: Column, ext: Column) -> Column:
    """Distinct symbols of meaningful hunks in order of first appearance (line, then rule)."""
    text = F.regexp_replace(join_lines(kept_hunks), r"(?md)^[+\-@ ]+", "")
    lines = F.split(text, "\n", -1)

    def scan(patterns: list[str]) -> Column:
        names = F.flatten(F.transform(lines, lambda line: line_names(line, patterns)))
        return F.array_distinct(F.filter(names, lambda n: n != ""))

    none = F.array().cast("array<string>")
    chosen = F.when(F.size(kept_hunks) == 0, none)
    for language, extensions in SYMBOL_EXTENSIONS.items():
        chosen = chosen.when(ext.isin(*extensions), scan(SYMBOL_PATTERNS[language]))
    return chosen.otherwise(none)


def with_symbols(files: DataFrame) -> DataFrame:
    """Add ``symbols``; both noise filters always apply here."""
    kept = computed(files, _kept=meaningful(F.col("hunks"), F.col("extension")))
    return kept.withColumn("symbols", symbol_list(F.col("_kept"), F.col("extension"))).drop("_kept")


def symbol_table(files: DataFrame) -> DataFrame:
    """``patch_id, file_seq, ord, symbol``; ``ord`` counts from 1."""
    return (
        with_symbols(changed_only(files))
        .select("patch_id", "file_seq", F.posexplode_outer("symbols").alias("pos", "symbol"))
        .where("symbol is not null")
        .select("patch_id", "file_seq", (F.col("pos") + 1).alias("ord"), "symbol")
    )
