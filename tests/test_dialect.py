"""Rules mean the same to Spark as to Python's re module."""

import random
import re

from pyspark.sql import functions as F

from diffloom.functions import rules
from diffloom.functions.dialect import java_regex, required_words
from diffloom.functions.text import extension, split_lines, strip, subsystem

PIECES = [
    " ", "  ", "\t", "\n", "\xa0", "\x1f", "\u2003", "\r", "\x85", "\u2028", "\xe9", "e\u0301", "\u017f", "_",
    "9", "\u0663",
    "(", ")", "{", "}", "[", "]", "<", ">", ";", ":", ".", ",", "*", "=", "'", '"', "-", "+", "#", "/", "@", "~",
    "eval", "exec", "new", "delete", "free", "virtual", "class", "interface", "public", "static", "abstract",
    "def", "self", "import", "from", "using", "namespace", "require", "export", "default", "function", "const",
    "async", "await", "Lock", "thread", "TODO", "hack", "struct", "app", "get", "module", "exports", "if", "else",
    "switch", "case", "for", "while", "in", "try", "catch", "emit", "on", "dispatch", "Execution Region", "Code",
    "Size", "refers to", "x.o(", "std::thread", "Task", "auth", "db_", "api", "base", "config", "x", "Foo", "malloc",
]


def texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(count)]


def all_patterns():
    out = [(p, "i") for p in rules.HIGH_RISK_PATHS + rules.ELEVATED_PATHS]
    out += rules.DANGEROUS_CONTENT + rules.NOTABLE_CONTENT
    out += rules.CONCURRENCY_PATTERNS + rules.MEMORY_PATTERNS
    out += [(p, "") for ps in rules.SYMBOL_PATTERNS.values() for p in ps]
    multi = rules.API_PATTERNS + rules.IMPORT_PATTERNS
    multi += rules.NEW_COMPONENT_PATTERNS + rules.REMOVED_COMPONENT_PATTERNS
    out += [(p, "m") for p in multi]
    out += [(p, "") for p in rules.NON_SOURCE_LINES]
    out += [(p, "") for p, _ in rules.EVENT_PATTERNS]
    return list(dict.fromkeys(out))


def test_every_rule_matches_like_python(spark):
    patterns, samples = all_patterns(), texts(700, seed=7)
    table = spark.createDataFrame([(s,) for s in samples], "s string")
    found = [
        F.regexp_extract_all("s", F.lit(java_regex(p, flags)), F.lit(0)).alias(f"c{k}")
        for k, (p, flags) in enumerate(patterns)
    ]
    for row in table.select("s", *found).collect():
        for k, (pattern, flags) in enumerate(patterns):
            option = (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0)
            expected = [m.group(0) for m in re.finditer(pattern, row.s, option)]
            assert row[f"c{k}"] == expected, (pattern, row.s)


def test_line_split_and_strip_like_python(spark):
    samples = texts(500, seed=3) + ["", "\n", "a\r\nb\n", "a\x0b\x0cb", "x "]
    table = spark.createDataFrame([(s,) for s in samples], "s string")
    for row in table.select("s", split_lines(F.col("s")).alias("l"), strip(F.col("s")).alias("t")).collect():
        assert row.l == row.s.splitlines(), repr(row.s)
        assert row.t == row.s.strip(), repr(row.s)


def test_path_helpers(spark):
    cases = {
        "src/a.PY": ("py", "src"), "src/auth/x.tar.gz": ("gz", "auth"), ".gitignore": ("", ".gitignore"),
        "a/.env": ("", "a"), "x.": ("", "x."), "lib\\Core\\m.h": ("h", "Core"), "Engine/core.cpp": ("cpp", "Engine"),
        "app/src/x.c": ("c", "app"),
    }
    table = spark.createDataFrame([(p,) for p in cases], "p string")
    for row in table.select("p", extension(F.col("p")).alias("e"), subsystem(F.col("p")).alias("s")).collect():
        assert (row.e, row.s) == cases[row.p], row.p


def test_required_words_are_in_every_match():
    samples = texts(20_000, seed=11)
    for pattern, flags in all_patterns():
        words = required_words(pattern)
        option = (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0)
        for sample in samples if words else []:
            for m in re.finditer(pattern, sample, option):
                found = m.group(0).upper().lower() if "i" in flags else m.group(0)
                wanted = [w.lower() for w in words] if "i" in flags else words
                assert any(w in found for w in wanted), (pattern, m.group(0))
