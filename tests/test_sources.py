import difflib
import random

import pytest

from diffloom.operators.parse import changed_only, hunk_table, parse_patches
from diffloom.operators.statistics import file_stats
from diffloom.sources.compare_report import load_report
from diffloom.sources.patches import load_patches, patch_table, read_patch_files
from diffloom.operators.architecture import arch_facts
from diffloom.sources.snapshots import (
    as_change_set,
    changed_pairs,
    compare_file_pairs,
    compare_snapshots,
    is_text,
    read_snapshot,
    snapshot_status,
)


def test_patch_files(spark, tmp_path):
    (tmp_path / "a.patch").write_bytes(b"--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+caf\xe9\n")
    (tmp_path / "b.patch").write_text("")
    row = load_patches(spark, str(tmp_path)).first()
    assert row.path == "x.py" and row.added == 1 and row.body.endswith("+caf�")
    # An empty file has no lines and gives no row.
    assert [r.patch_id[-7:] for r in read_patch_files(spark, str(tmp_path)).collect()] == ["a.patch"]
    table = spark.createDataFrame([(7, row.body)], "n int, t string")
    assert patch_table(table, "n", "t").dtypes == [("patch_id", "string"), ("content", "string")]


def test_xml_report(spark, tmp_path):
    (tmp_path / "r.xml").write_text("""<report><folder>
      <item leftfile="a.c" rightfile="b/a.c" status="Different" leftlines="12" rightlines="+1_0"/>
      <sub><item leftfile="l.c" status="leftonly" leftlines="3"/></sub>
      <item leftfile="s.c" rightfile="s.c" status="identical" leftlines="1"/>
      <item leftfile="w.c" rightfile="w.c" status="weird" leftlines="1"/>
      <item leftfile="i.bin" rightfile="i.bin" status="binarydiffer"/>
      <item leftfile="n.c" rightfile="n.c" status="error" leftlines="x"/>
      <item leftfile="z.c" rightfile="z.c" status="rightonly" leftlines="0" rightlines="5"></item>
    </folder></report>""")
    rows = {r.old_path: r for r in load_report(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.c", "l.c", "i.bin", "n.c", "z.c"}
    assert rows["a.c"].body == "+[10 lines in new file]\n-[12 lines in old file]"
    assert (rows["a.c"].added, rows["a.c"].deleted) == (1, 1)
    assert rows["l.c"].path == "" and rows["l.c"].deleted == 1
    assert rows["i.bin"].binary and rows["i.bin"].n_hunks == 0
    assert rows["z.c"].body == "+[5 lines in new file]"
    assert changed_only(load_report(spark, str(tmp_path))).where("old_path = 'n.c'").count() == 0


def tree(spark, files):
    rows = [(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def test_snapshot_statuses(spark):
    left = tree(spark, {"x.py": "a\n", "gone.py": "b\n", "crlf.py": "a\r\nb\r", "i.bin": bytes(range(256)),
                        "mod.py": "1\n2\n3\n", "cut": "é" * 300, "bad": b"\xff" * 600})
    right = tree(spark, {"x.py": "a\n", "new.py": "c\nd\n", "crlf.py": "a\nb\n", "i.bin": bytes(range(256)),
                         "mod.py": "1\n3\n3\n", "cut": "é" * 300, "bad": b"\xff" * 601})
    got = {r.path: (r.status, r.binary, r.bytes_equal) for r in snapshot_status(left, right).collect()}
    assert got == {
        "x.py": ("equal", False, False), "gone.py": ("removed", False, False), "new.py": ("added", False, False),
        "crlf.py": ("equal", False, False), "i.bin": ("changed", True, True), "mod.py": ("changed", False, False),
        "cut": ("equal", False, False), "bad": ("changed", True, False)}
    files = {r.path: r for r in compare_snapshots(left, right, ["*.pyc"]).collect()}
    assert set(files) == {"gone.py", "new.py", "i.bin", "mod.py", "bad"}
    assert files["new.py"].old_path == "/dev/null" and files["new.py"].hunks == ["@@ -0,0 +1,2 @@\n+c\n+d"]
    assert files["gone.py"].new_path == "/dev/null" and files["gone.py"].hunks == ["@@ -1 +0,0 @@\n-b"]
    assert (files["mod.py"].added, files["mod.py"].deleted) == (1, 1)


def test_line_diffs_match_the_standard_library(spark):
    rng = random.Random(2)
    left = {f"f{i}.txt": "".join(rng.choice("ab c\n") for _ in range(60)) for i in range(25)}
    right = {p: "".join(c for c in t if rng.random() > 0.1) + rng.choice(["", "\n", "z"]) for p, t in left.items()}
    got = {r.path: r.hunks for r in compare_snapshots(tree(spark, left), tree(spark, right)).collect()}
    ends = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    for path, old in left.items():
        lines = list(difflib.unified_diff(old.splitlines(True), right[path].splitlines(True), n=5))[2:]
        text = "".join(x if x[-1] in ends else x + "\n" for x in lines).strip("\n")
        assert "\n".join(got.get(path, [])).strip("\n") == text, path


def test_other_line_ends_add_no_empty_line(spark):
    old, new = "one\n\f\ntwo\u0085three\n", "one\n\f\ntwo\u0085four\n"
    files = compare_snapshots(tree(spark, {"a.c": old}), tree(spark, {"a.c": new}))
    assert files.first().hunks == ["@@ -1,5 +1,5 @@\n one\n \n \n two\n-three\n+four"]


def test_contents_of_binary_files_are_not_fetched(spark):
    one = tree(spark, {"i.bin": bytes(range(256)), "a.py": "x\n"})
    two = tree(spark, {"i.bin": bytes(range(255)), "a.py": "y\n"})
    rows = {r.path: r for r in changed_pairs(one, two).collect()}
    assert rows["i.bin"].binary and rows["i.bin"].left_doc is None and rows["a.py"].right_doc == "y\n"


def test_probe_is_an_option(spark):
    late = b"a" * 600 + b"\xff"
    table = tree(spark, {"late": late})
    for probe, expected in ((512, True), (None, False), (700, False)):
        got = table.select(is_text(table.path, table.content, probe).alias("t")).first().t
        assert got is expected


def test_placeholder_hunks_have_header_numbers(spark, tmp_path):
    item = '<item leftfile="a.c" rightfile="b.c" status="different" leftlines="{}" rightlines="{}"/>'
    body = item.format(7, 12) + item.format(3, "x") + item.format(0, 0)
    (tmp_path / "r.xml").write_text(f"<report><folder>{body}</folder></report>")
    rows = hunk_table(load_report(spark, str(tmp_path))).orderBy("file_seq").collect()
    assert [(r.old_start, r.old_count, r.new_start, r.new_count) for r in rows] == [
        (1, 7, 1, 12), (1, 3, 1, 0), (1, 0, 1, 0)]


def test_missing_final_newline_keeps_lines_apart(spark):
    files = compare_snapshots(tree(spark, {"a.py": "x = 1"}), tree(spark, {"a.py": "x = 2"}))
    assert files.first().hunks == ["@@ -1 +1 @@\n-x = 1\n+x = 2"]


def test_folders_and_exclude(spark, tmp_path):
    for side, text in (("left", "1\n"), ("right", "2\n")):
        for name in ("src/a.py", "build/deep/b.py", "c d.py"):
            file = tmp_path / side / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(text)
    left, right = (read_snapshot(spark, str(tmp_path / side)) for side in ("left", "right"))
    assert {r.path for r in left.collect()} == {"src/a.py", "build/deep/b.py", "c d.py"}
    files = compare_snapshots(left, right, ["build/*"])
    assert {r.path for r in file_stats(files).collect()} == {"src/a.py", "c d.py"}


def test_file_pairs(spark):
    rows = [("l.py", "r.py", bytearray(b"a\n"), bytearray(b"b\n")), ("s.py", "s.py", bytearray(b"a"), bytearray(b"a")),
            ("i.bin", "j.bin", bytearray(b"\xff"), bytearray(b"\xff"))]
    pairs = spark.createDataFrame(rows, "left_path string, right_path string, left binary, right binary")
    got = {r.old_path: r for r in compare_file_pairs(pairs).collect()}
    assert got["a/l.py"].new_path == "b/r.py" and got["a/l.py"].added == 1
    assert got["a/s.py"].n_hunks == 0 and not got["a/s.py"].binary
    assert got["a/i.bin"].binary
    assert changed_only(compare_file_pairs(pairs)).count() == 2


def test_bad_text_column_is_an_error(spark):
    with pytest.raises(Exception):
        parse_patches(spark.createDataFrame([(1,)], "x int")).count()


def test_change_set_numbers_by_path_and_joins_facts(spark):
    left = tree(spark, {"b.py": "import os\nx\n", "a.py": "y\n", "é.py": "1\n", "Z.py": "1\n"})
    right = tree(spark, {"b.py": "x\n", "a.py": "import os\nimport re\ny\n", "é.py": "2\n", "Z.py": "2\n"})
    files = as_change_set(compare_snapshots(left, right), "cmp")
    assert [(r.patch_id, r.file_seq, r.path) for r in files.orderBy("file_seq").collect()] == [
        ("cmp", 1, "Z.py"), ("cmp", 2, "a.py"), ("cmp", 3, "b.py"), ("cmp", 4, "é.py")]
    facts = arch_facts(files).where("kind = 'dependency_change'")
    assert [r.text for r in facts.collect()] == ["New dependency: `re`"]
