import os
import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators.parse import parse_patches
from diffloom.operators.pieces import piece_file_stats
from diffloom.operators.statistics import file_stats
from diffloom.sources.file_tree import (
    FileTreeReader,
    Ranges,
    glob_excludes,
    glob_prunes,
    list_files,
    read_files,
    read_text_runs,
    write_files,
    write_text_runs,
)
from diffloom.sources.patches import read_patch_files, read_patch_pieces
from diffloom.sources.snapshots import compare_folders, compare_snapshots, read_snapshot

NAMES = ["src/__init__.py", ".gitignore", "_build/deep/x.o", "a b/é.py", "src/.cache/y.log", "docs/z.log", "top", "docs/_x/__a",
         "src/deep/er/f.py", "empty/.keep"]


@pytest.fixture
def tree(tmp_path):
    def make(name, files):
        for path, content in files.items():
            file = tmp_path / name / path
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(tmp_path / name)

    return make


def listed(table):
    return sorted(r.path for r in table.collect())


def test_every_name_is_listed_with_its_length(spark, tree):
    folder = tree("t", {n: n * 3 for n in NAMES})
    os.symlink(f"{folder}/src", f"{folder}/docs/link")  # a link to a folder may be part of a circle
    os.symlink(f"{folder}/top", f"{folder}/docs/file_link")
    for folders in (1, 3, 100):
        got = list_files(spark, folder, folders=folders)
        assert listed(got) == sorted([*NAMES, "docs/file_link"])
    assert {r.path: r.length for r in got.collect()}["a b/é.py"] == len(("a b/é.py" * 3).encode())
    assert got.where("modified is null").isEmpty()
    read = {r.path: bytes(r.content).decode() for r in read_files(got, folder).collect()}
    assert read == {**{n: n * 3 for n in NAMES}, "docs/file_link": "top" * 3}


GLOBS = ["*.log", "_build/*", "*cache*", "top", "src/*.py", "s?c/deep/*", "[ab] b/*", "", "*", "docs", "*/", "**/er/*", "do*"]


@pytest.mark.parametrize("glob", GLOBS)
def test_globs_while_listing_equal_globs_on_the_table(spark, tree, glob):
    folder = tree("t", {n: "x" for n in NAMES})
    expected = sorted(n for n in NAMES if not glob_excludes([glob], n))
    assert listed(list_files(spark, folder, [glob], folders=2)) == expected
    assert listed(read_snapshot(spark, folder, [glob])) == expected


def test_pruned_folders_hold_nothing_that_is_wanted():
    for glob in GLOBS:
        for folder in ("src", "src/deep", "docs", "_build", "a b"):
            if glob_prunes([glob], folder):
                assert all(glob_excludes([glob], f"{folder}/{x}") for x in ("x", "y/z.py", ".h", "l.log"))
    assert glob_prunes(["_build/*"], "_build/deep") and not glob_prunes(["*.log"], "docs")


@pytest.mark.parametrize("condition", [
    "path = 'top'", "path in ('top', 'docs/z.log')", "startswith(path, 'src/')", "not startswith(path, 'src/')",
    "path like '%.py'", "not path like '%.py'", "contains(path, 'ee')", "path <> 'top'", "path <=> 'top'",
    "startswith(path, 'src/de') and not path like '%er/%'", "path not in ('top', '.gitignore')"])
def test_filters_on_paths_are_pushed(spark, tree, condition):
    folder = tree("t", {n: "x" for n in NAMES})
    rows = list_files(spark, folder, folders=2).where(condition)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan and "BatchScan file_tree" in plan
    table = spark.createDataFrame([(n,) for n in NAMES], "path string")
    assert listed(rows) == listed(table.where(condition))


def test_other_filters_stay_in_the_plan(spark, tree):
    rows = list_files(spark, tree("t", {n: n for n in NAMES})).where("length > 8 and length(path) < 12")
    assert listed(rows) == sorted(n for n in NAMES if len(n.encode()) > 8 and len(n) < 12)


def test_excluded_files_are_neither_listed_nor_read(spark, tree, monkeypatch):
    folder = tree("t", {"keep/a": "1", "skip/b": "2", "skip/deep/c": "3", "x.bin": "4"})
    entered = []
    real = FileTreeReader.children
    monkeypatch.setattr(FileTreeReader, "children", lambda self, s, b, f: entered.append(f) or real(self, s, b, f))
    reader = FileTreeReader({"path": folder, "exclude": '["skip/*"]', "folders": "1"})
    found = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    assert sorted(found) == ["keep/a", "x.bin"] and "skip" not in entered
    os.chmod(f"{folder}/x.bin", 0)
    os.remove(f"{folder}/x.bin")
    os.mkfifo(f"{folder}/x.bin")  # would wait for ever if it was opened
    assert {r.path for r in read_snapshot(spark, folder, ["skip/*", "*.bin"]).collect()} == {"keep/a"}


def test_empty_folder_and_missing_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert read_snapshot(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="gone"):
        list_files(spark, str(tmp_path / "gone")).collect()


def test_written_files_are_whole_and_paths_are_checked(spark, tmp_path):
    rows = [("a/.b/c", "x"), ("_d", None), ("é/f g", "y" * 100_000)]
    folder = str(tmp_path / "out")
    write_files(spark.createDataFrame(rows, "path string, content string"), folder)
    got = {r.path: bytes(r.content).decode() for r in read_snapshot(spark, folder).collect()}
    assert got == {p: c or "" for p, c in rows}
    assert os.listdir(tmp_path) == ["out"]
    for bad in (["/x"], ["a/../b"], [""], ["a//b"], [None], ["same", "same"], ["d/"], ["./a"]):
        with pytest.raises(ValueError):
            write_files(spark.createDataFrame([(p, "x") for p in bad], "path string, content string"), folder)


def test_folders_are_compared_with_all_their_names(spark, tree):
    left = {"src/__init__.py": "a\n", ".gitignore": "x\n", "gone/_y": "1\n", "same": "s\n", "i.bin": b"\xff\x00", "skip.log": "1\n"}
    right = {"src/__init__.py": "b\n", ".gitignore": "x\n", "new/.z": "2\n3\n", "same": "s\n", "i.bin": b"\xff\x00", "skip.log": "2\n"}
    a, b = tree("left", left), tree("right", right)
    files = compare_folders(spark, a, b, ["*.log"])
    got = {r.path: (r.old_path, r.new_path, r.binary, r.added, r.deleted) for r in files.collect()}
    assert got == {
        "src/__init__.py": ("a/src/__init__.py", "b/src/__init__.py", False, 1, 1),
        "gone/_y": ("a/gone/_y", "/dev/null", False, 0, 1),
        "new/.z": ("/dev/null", "b/new/.z", False, 2, 0),
        "i.bin": ("a/i.bin", "b/i.bin", True, 0, 0),
    }
    tables = compare_snapshots(read_snapshot(spark, a), read_snapshot(spark, b), ["*.log"])
    columns = [c for c in files.columns if c != "path_repeats"]
    assert sorted(map(tuple, files.select(columns).collect())) == sorted(map(tuple, tables.select(columns).collect()))


def test_probe_reaches_the_comparison(spark, tree):
    a, b = tree("left", {"f": b"a" * 600 + b"\xff"}), tree("right", {"f": b"b" * 600 + b"\xff"})
    assert [r.binary for r in compare_folders(spark, a, b).collect()] == [False]
    assert [r.binary for r in compare_folders(spark, a, b, probe_bytes=None).collect()] == [True]


def test_hidden_patch_files(spark, tree):
    text = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+y\n"
    folder = tree("p", {"a.patch": text, "_b.patch": text, ".c.patch": text, ".empty": ""})
    assert [r.patch_id.rsplit("/")[-1] for r in read_patch_files(spark, folder).collect()] == ["a.patch"]
    got = read_patch_files(spark, folder, hidden=True).collect()
    assert sorted(r.patch_id.rsplit("/")[-1] for r in got) == [".c.patch", "_b.patch", "a.patch"]
    assert len({r.patch_id.rsplit("/", 1)[0] for r in got}) == 1 and {r.content for r in got} == {text}


LINES = ["--- a/x.py", "+++ b/x.py", "--- /dev/null", "@@ -1 +1 @@", "+a" * 9, "-b", " c", "+++ z", "Binary files differ", "",
         "\\ No newline", "\rq", "é" * 20]


@pytest.mark.parametrize("size", [1, 7, 40, 333, 5000])
def test_ranges_of_a_file_are_its_pieces(size):
    import io

    rng = random.Random(size)
    for end in (b"\n", b""):
        text = "\n".join(rng.choice(LINES) for _ in range(90)).encode() + end
        pieces = []
        for step in (3, 1 << 20):
            cutter = Ranges(io.BytesIO(text), len(text), size, step)
            pieces.append([cutter.piece(i) for i in range(-(-len(text) // size))])
        assert pieces[0] == pieces[1]
        found = [p for p in pieces[0] if p is not None]
        assert b"".join(found) == text and all(found)
        assert all(p.endswith(b"\n") for p in found[:-1])
        # A range that has a file header is cut there.
        for i, p in enumerate(pieces[0][1:], 1):
            at = text.find(b"\n--- ", i * size - 1)
            if 0 <= at and at + 1 < min((i + 1) * size, len(text)):
                assert p.startswith(b"--- ")


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_a_large_file_has_the_statistics_of_its_parts(spark, tree, size):
    rng = random.Random(3)
    texts = {f"{'_' * (k % 2)}p{k}.patch": "\n".join(rng.choice(LINES) for _ in range(400 * (1 + 3 * (k == 0)))) + "\n" for k in range(4)}
    folder = tree("p", texts)
    whole = spark.createDataFrame(list(texts.items()), "patch_id string, content string")
    pieces = read_patch_pieces(spark, folder, piece_bytes=size)
    columns = ["patch_id", "file_seq", "path", "extension", "binary", "n_hunks", "added", "deleted"]

    def rows(table):
        return sorted(tuple(r) for r in table.select(columns).collect())

    assert rows(piece_file_stats(pieces)) == rows(file_stats(parse_patches(whole)))
    longest = pieces.agg(F.max(F.octet_length("content"))).first()[0]
    assert size > 1000 or longest < 3 * size + 100


def test_many_folders_are_dealt_to_a_fixed_number_of_tasks(tree):
    files = {f"d{i}/f": "1" for i in range(40)} | {"src/a/b": "2", "x": "3"}
    reader = FileTreeReader({"path": tree("t", files), "folders": "4"})
    parts = reader.partitions()
    # A task for each folder made listing a wide tree as many tasks as it has folders.
    assert len(parts) == 4
    found = [p for part in parts for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    assert sorted(found) == sorted(files)


def test_text_runs_of_many_keys(spark, tmp_path):
    keys = ["007", "a=b/c %+é", None, "x"]
    table = spark.createDataFrame([(k, f"{k} {i}") for k in keys for i in range(3)], "patch_id string, text string")
    folder = str(tmp_path / "runs")
    write_text_runs(table.coalesce(1), folder)
    got = {r.key: (r.part, r.value) for r in read_text_runs(spark, folder).collect()}
    # One file for each key, written by the task itself, and keys stay text.
    assert {k: v for k, (_, v) in got.items()} == {k: "".join(f"{k} {i}\n" for i in range(3)) for k in keys}
    assert all(part.startswith("part-00000-") for part, _ in got.values())
    assert not list(tmp_path.glob("*.staging-*"))
    with pytest.raises(ValueError, match="already"):
        write_text_runs(table, folder)
