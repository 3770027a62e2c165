import random
import re

from pyspark.sql import functions as F

from diffloom.functions import rules
from diffloom.operators.context import keep_mask, limit_context
from diffloom.operators.hunk_filters import with_meaningful
from diffloom.operators.redaction import (
    API_SAFE,
    API_SAFE_COMMENTS,
    FULL,
    SIGNATURE,
    placeholder,
    preserved_in_api_safe,
    pseudonymize_line,
    strip_files,
    strip_hunk,
)


def redact(spark, lines, mode, path="a.cpp", strict=False):
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    out = table.select("i", pseudonymize_line(F.col("line"), F.lit(path), mode, strict).alias("t"))
    return [r.t for r in out.orderBy("i").collect()]


def test_placeholder_values(spark):
    path = F.lit("Src/auth/SessionManager.cpp")
    names = ["SessionManager", "ValidateToken", "token"]
    row = spark.range(1).select(*[placeholder(F.lit(n), path) for n in names]).first()
    assert list(row) == ["sym_4f987b", "sym_d8bce1", "sym_490e3e"]


def test_preserved_names(spark):
    yes = ["MAX_FAILURES", "AuditLog", "GetURL", "Settings", "uint8_t", "return", "_X", "Get"]
    no = ["EOF", "token", "m_secret_key", "HTTPServer", "getUrl"]
    table = spark.createDataFrame([(n,) for n in yes + no], "n string")
    kept = {r.n for r in table.where(preserved_in_api_safe(F.col("n"))).collect()}
    assert kept == set(yes)


def test_passes(spark):
    lines = [
        '+    #include "Foo.h"', "-if (count > 42 && val == 1)", "+process(0, -1, 3.14f, 1e-5)",
        ' s = f"abc" + "x\\"y"', "+café = a.b5", "", "+x = 10.0.0.1",
    ]
    out = redact(spark, lines, FULL)
    assert out[0] == '+    #include "<str>"'
    assert re.fullmatch(r"-if \(sym_\w{6} > <n> && sym_\w{6} == 1\)", out[1])
    assert re.fullmatch(r"\+sym_\w{6}\(0, -1, <n>, <n>\)", out[2])
    # A prefix glued to a literal hides the whole literal as one name.
    assert re.fullmatch(r' sym_\w{6} = sym_\w{6} \+ "<str>"', out[3])
    assert re.fullmatch(r"\+café = sym_\w{6}\.sym_\w{6}", out[4])
    assert out[5] == ""
    assert re.fullmatch(r"\+sym_\w{6} = <n>\.0\.1", out[6])
    assert redact(spark, lines, SIGNATURE) == out


def test_comment_mode(spark):
    lines = ["+int total = 5; // the Total of x", "+#include <a.h>", "+a /* keep me */ b /* and me */", "+foo//c",
             '+u = "http://host/x";']
    out = redact(spark, lines, API_SAFE_COMMENTS)
    assert re.fullmatch(r"\+int sym_\w{6} = <n>; // the Total of x", out[0])
    assert out[1] == lines[1]
    assert re.fullmatch(r"\+sym_\w{6} /\* keep me \*/ sym_\w{6} /\* and me \*/", out[2])
    assert re.fullmatch(r"\+sym_\w{6}", out[3])
    assert out[4].endswith("//host/x\";")
    assert "the Total" not in redact(spark, lines, API_SAFE_COMMENTS, strict=True)[0]


def test_long_literal_does_not_overflow(spark):
    line = '+x = "' + "a\\\"" * 60_000 + '";'
    assert re.fullmatch(r'\+sym_\w{6} = "<str>";', redact(spark, [line], FULL)[0])


def test_names_equal_within_a_file_only(spark):
    one, two = redact(spark, ["+a = a", "+a"], FULL)
    assert len(set(re.findall(r"sym_\w{6}", one + two))) == 1
    assert redact(spark, ["+a"], FULL, path="b.cpp")[0] != two


def brute_mask(kinds, width):
    changed = [i for i, k in enumerate(kinds) if k in "+-"]
    return [any(abs(i - c) <= width for c in changed) for i in range(len(kinds))]


def test_mask_and_islands_against_brute_force(spark):
    rng = random.Random(5)
    hunks = []
    for i in range(60):
        kinds = [rng.choice("   +-\\") for _ in range(rng.randint(0, 25))]
        hunks.append((i, "\n".join(["@@ -1 +1 @@ tail()"] + [k + "word" for k in kinds])))
    table = spark.createDataFrame(hunks, "i int, hunk string")
    for width in (0, 1, 3):
        body = F.slice(F.split("hunk", "\n"), 2, 1000)
        out = table.select(
            "hunk", keep_mask(body, width).alias("mask"),
            strip_hunk(F.col("hunk"), F.lit("p"), API_SAFE, width).alias("lines"))
        for row in out.collect():
            lines = row.hunk.split("\n")[1:]
            mask = brute_mask([x[:1] for x in lines], width)
            assert row.mask == mask
            marks = re.sub("0+", lambda m: f"[{len(m.group())}]", "".join("01"[k] for k in mask))
            got = "".join(
                f"[{m.group(1)}]" if (m := re.match(r"··· \[(\d+) line\(s\) redacted\] ···$", x)) else "1"
                for x in row.lines[1:])
            assert got == marks
            assert row.lines[0] == "@@ -1 +1 @@ tail()"


def test_collapsed_comments_and_strict_header(spark):
    hunk = "@@ -1 +1 @@ secret()\n a // one\n b /* two */ # three\n c\n+d"
    table = spark.createDataFrame([(hunk,)], "h string")
    lines, strict = table.select(
        strip_hunk(F.col("h"), F.lit("p"), API_SAFE_COMMENTS, 0),
        strip_hunk(F.col("h"), F.lit("p"), API_SAFE_COMMENTS, 0, strict=True)).first()
    assert lines[1] == "··· [3 line(s) redacted] ···  // one  # three  /* two */"
    custom = table.select(strip_hunk(F.col("h"), F.lit("p"), FULL, 0, collapse_marker="<{n}>")).first()[0]
    assert custom[1] == "<3>"
    assert strict[:2] == ["@@ -1 +1 @@", "··· [3 line(s) redacted] ···"]


def test_hunk_without_header(spark):
    table = spark.createDataFrame([("+[5 lines in new file]\n-[3 lines in old file]",)], "h string")
    lines = table.select(strip_hunk(F.col("h"), F.lit("p"), FULL, 1)).first()[0]
    assert len(lines) == 2 and all("<n>" in x for x in lines)


def test_strip_files_numbers_kept_hunks(parse):
    files = with_meaningful(parse("--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n+// c\n@@ -2 +2 @@\n+d"))
    rows = strip_files(files).orderBy("ord").collect()
    assert [(r.hunk_seq, r.ord) for r in rows] == [(1, 0), (1, 1)] and rows[0].text == "@@ -2 +2 @@"


def brute_budget(lines, budget):
    out, used = [], 0
    for line in lines:
        used = used + 1 if line.startswith(" ") else 0
        if used <= budget or line == lines[-1]:
            out.append(line)
    return out


def test_context_budget_against_brute_force(spark):
    rng = random.Random(9)
    hunks = [
        (i, "\n".join(["@@ -1 +1 @@"] + [rng.choice([" a", " b", "+c", "-d", "", "\\ x"]) for _ in range(12)]))
        for i in range(80)
    ]
    table = spark.createDataFrame(hunks, "i int, h string")
    for budget in (0, 1, 3):
        for row in table.select("h", limit_context(F.col("h"), budget).alias("t")).collect():
            assert row.t.split("\n") == brute_budget(row.h.split("\n"), budget), row.h


def test_keyword_list_sizes():
    assert len(set(rules.KEPT_WORDS)) == 118
    assert len(rules.KEPT_TYPES) == 25 - 1 + 1 and len(rules.PUBLIC_PREFIXES) == 31


def test_hunks_with_little_context_are_not_cut_apart(spark):
    hunks = ["@@ -1 +1 @@\n a\n+b\n c", "@@ -1 +1 @@\n a\n b\n+c", "", None]
    table = spark.createDataFrame([(h,) for h in hunks], "h string").select("h", limit_context(F.col("h"), 2).alias("t"))
    assert all(row.t == row.h for row in table.collect())
    # Only what has more context than the budget is split; the last line needs no search.
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "CASE WHEN" in plan
