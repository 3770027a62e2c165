from patch_texts import patch
from pyspark.sql import functions as F

from diffloom.operators.hunk_filters import with_meaningful, with_noise_flags
from diffloom.operators.parse import changed_only, diff_lines, hunk_table, post_image

TWO_FILES = """\
diff --git a/src/a.py b/src/a.py
--- a/src/a.py\t2024-01-01
+++ b/src/a.py\t2024-01-02
@@ -5 +5,2 @@ def f():
 keep
-old
+new
+newer
\\ No newline at end of file
diff --git a/src/b.cpp b/src/b.cpp
index 123..456 100644
--- a/src/b.cpp
+++ b/src/b.cpp
@@ -1,2 +1,2 @@
 x
@@ -10,3 +10,3 @@
-y
+z
"""


def test_files_hunks_and_lines(parse):
    files = parse(TWO_FILES)
    rows = files.orderBy("file_seq").collect()
    assert [(r.path, r.extension, r.n_hunks, r.added, r.deleted) for r in rows] == [
        ("src/a.py", "py", 1, 2, 1),
        ("src/b.cpp", "cpp", 2, 1, 1),
    ]
    hunks = hunk_table(files).orderBy("file_seq", "hunk_seq").collect()
    assert [(h.old_start, h.old_count, h.new_start, h.new_count) for h in hunks] == [
        (5, 1, 5, 2), (1, 2, 1, 2), (10, 3, 10, 3)]
    first = diff_lines(files).where("file_seq = 1").orderBy("line_no").collect()
    # Git lines of the next file stay with the hunk before them.
    assert [r.kind for r in first] == ["header", "ctx", "del", "add", "add", "other", "other", "other"]
    code = files.where("file_seq = 1").select(post_image(F.col("body"))).first()[0]
    assert code == "keep\nnew\nnewer"


def test_new_deleted_binary_and_identical(parse):
    text = (
        "--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+x\n"
        "--- a/old.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
        "--- a/img.bin\n+++ b/img.bin\nBinary files a/img.bin and b/img.bin differ\n"
        "--- a/same.py\n+++ b/same.py\n"
        "--- a/b.py\n+++ b/a/foo.py\n"
        "--- a/only_old.py\n"
    )
    rows = parse(text).orderBy("file_seq").collect()
    assert [r.path for r in rows] == ["new.py", "old.py", "img.bin", "same.py", "foo.py", ""]
    assert [r.binary for r in rows] == [False, False, True, False, False, False]
    assert [r.file_seq for r in changed_only(parse(text)).orderBy("file_seq").collect()] == [1, 2, 3]


def test_headers_inside_hunks_are_consumed(parse):
    # A deleted line "-- x" opens a file, an added line "++ y" renames it.
    text = "--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1,2 @@\n-a\n--- comment\n+++ other\n@@ -3 +3 @@\n+b\n"
    rows = parse(text).orderBy("file_seq").collect()
    assert [(r.old_path, r.new_path, r.added, r.deleted) for r in rows] == [
        ("a/x.sql", "b/x.sql", 0, 1), ("comment", "other", 1, 0)]


def test_empty_and_preamble_only(parse):
    assert parse("", "no diff here\n@@ -1 +1 @@\n+x").count() == 0


def test_line_separators(parse):
    files = parse("--- a/x.c\r\n+++ b/x.c\r\n@@ -1 +1 @@\r\n+a\x0b-b +c\r")
    assert files.select("added", "deleted", "path").first() == (2, 1, "x.c")


def flags(parse, text):
    return [
        (h.ws_only, h.comment_only)
        for h in with_noise_flags(hunk_table(parse(text))).orderBy("hunk_seq").collect()
    ]


def test_whitespace_only(parse):
    head = "--- a/x.py\n+++ b/x.py\n"
    text = head + "\n".join([
        "@@ -1 +1 @@", "-    pass  ", "+\tpass",
        "@@ -2 +2 @@", "-a b", "-c", " ctx", "+c", "+a  b",
        "@@ -3 +3 @@", "-a b", "+ab",
        "@@ -4 +4 @@", " only context",
        "@@ -5 +5 @@", "-", "+  ",
    ])
    assert [f[0] for f in flags(parse, text)] == [True, True, False, False, True]


def test_comment_only(parse):
    body = "@@ -1 +1 @@\n+  # note\n-\n@@ -2 +2 @@\n+// note\n@@ -3 +3 @@\n+x = 1  # note"
    assert [f[1] for f in flags(parse, "--- a/x.py\n+++ b/x.py\n" + body)] == [True, False, False]
    assert [f[1] for f in flags(parse, "--- a/x.c\n+++ b/x.c\n" + body)] == [False, True, False]


def test_switches(parse):
    files = parse("--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n-a\n+ a\n@@ -2 +2 @@\n+// c\n@@ -3 +3 @@\n+d")
    kept = lambda **s: with_meaningful(files, **s).first().n_kept
    assert kept() == 1
    assert kept(skip_whitespace=False) == 2
    assert kept(skip_comments=False) == 2
    assert kept(skip_whitespace=False, skip_comments=False) == 3


def test_parse_needs_no_shuffle(parse):
    files = parse(patch("a.py", ["x"]))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
