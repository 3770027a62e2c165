"""Cheap tests in front of searches of whole texts must not change what these find."""

import random
import re

from pyspark.sql import functions as F

from diffloom.functions.text import strip, unify_newlines, without_last_newline
from diffloom.operators.parse import hunk_table, parse_patches
from diffloom.workload.fixtures import split_words

LINES = [
    "--- a/x.py", "--- /dev/null", "+++ b/x.py", "+++ b/y.py\t2024", "+++ /dev/null", "Binary files a and b differ",
    "@@ -1 +1 @@ f", "@@ -1,2 +3,4 @@", "@@ no header", "+a", "-b", " c", "", "+++", "--", "+++ +++ z",
]


def parsed(text):
    """Files of a patch by the definition, without any shortcut."""
    found = []
    for segment in re.split(r"\n(?=--- )", re.sub(r"\n\Z", "", "\n" + text))[1:]:
        head = segment.split("\n@@ ", 1)[0]
        tail = segment[len(head):]
        stray = "\n+++ " in tail or "\nBinary files" in tail
        new = (re.findall(r"(?m)^\+\+\+ ([^\t\n]*)", segment if stray else head) or [""])[-1]
        body = re.sub(r"\n(?:\+\+\+ |Binary files).*", "", segment) if stray else segment
        hunks = re.split(r"\n(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)", body)[1:]
        old = re.match(r"--- ([^\t\n]*)", segment).group(1)
        found.append((old, new, "\nBinary files" in segment, hunks))
    return found


def test_files_follow_the_definition(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choices(LINES, k=rng.randint(0, 14))) + rng.choice(["", "\n", "\n\n"]) for _ in range(400)]
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "patch_id string, content string")
    got = {}
    for r in parse_patches(table).orderBy("patch_id", "file_seq").collect():
        got.setdefault(int(r.patch_id), []).append((r.old_path, r.new_path, r.binary, r.hunks))
    assert {i: got.get(i, []) for i in range(len(texts))} == {i: parsed(t) for i, t in enumerate(texts)}


def test_header_numbers_are_read_from_the_first_line(spark):
    text = "--- a/x\n+++ b/x\n@@ -3 +4,5 @@ f\n+@@ -7,7 +7,7 @@\n-b\n"
    rows = hunk_table(parse_patches(spark.createDataFrame([("p", text)], "patch_id string, content string"))).collect()
    assert [(r.old_start, r.old_count, r.new_start, r.new_count, r.added, r.deleted) for r in rows] == [(3, 1, 4, 5, 1, 1)]


def test_line_ends_and_blanks(spark):
    spaces = "\t \x0b\x1c\x85\xa0  　"
    rows = ["", "\n", "a\n\n", "a\r\nb\rc", "a b\x85", f"{spaces}x{spaces}y{spaces}", None, spaces]
    table = spark.createDataFrame([(r,) for r in rows], "s string")
    s = F.col("s")
    for r in table.select("s", without_last_newline(s).alias("w"), unify_newlines(s).alias("u"), strip(s).alias("t")).collect():
        if r.s is None:
            assert (r.w, r.u, r.t) == (None, None, None)
            continue
        assert r.w == re.sub(r"\n\Z", "", r.s) and r.t == r.s.strip()
        assert r.u == re.sub("\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n", r.s)


def test_words_of_a_document():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(" \nab\t", k=rng.randint(0, 7)))
        assert split_words(text) == re.split("[ \n]+", text)
