import random

import pytest

import diffloom.operators.pieces as pieces
from diffloom.operators.hunk_filters import with_meaningful, with_noise_flags
from diffloom.operators.parse import changed_only, hunk_table, parse_patches
from diffloom.operators.piece_hunks import Pieces
from diffloom.operators.statistics import file_stats, file_tokens
from diffloom.operators.symbols import symbol_table

LINES = ["--- a/x.py", "+++ b/x.py", "--- /dev/null", "+++ b/y.c\t1", "@@ -1 +1 @@", "+a", "-b", " c", "+++ z", "---",
         "Binary files differ", "", "\\ No newline"]


def test_pieces_equal_the_whole_patch(spark, monkeypatch):
    # Small blocks, so that several levels of numbering take part.
    monkeypatch.setattr(pieces, "PIECES_PER_BLOCK", 3)
    rng = random.Random(4)
    whole, cut = [], []
    for p in range(40):
        lines = [rng.choice(LINES) for _ in range(60)]
        whole.append((str(p), "\n".join(lines) + "\n"))
        number, at = 0, 0
        while at < len(lines):
            step = rng.randint(1, 6)
            cut.append((str(p), number, "\n".join(lines[at:at + step]) + "\n"))
            number, at = number + rng.randint(1, 2), at + step
    expected = file_stats(parse_patches(spark.createDataFrame(whole, "patch_id string, content string")))
    got = pieces.piece_file_stats(
        spark.createDataFrame(cut, "patch_id string, piece_no int, content string"))

    def rows(table):
        return sorted(tuple(r) for r in table.select(
            "patch_id", "file_seq", "path", "extension", "binary", "n_hunks", "added", "deleted").collect())

    assert rows(got) == rows(expected)


def test_no_task_gets_a_whole_patch_of_text(spark):
    table = spark.createDataFrame([("p", 0, "x")], "patch_id string, piece_no int, content string")
    parts = pieces.piece_parts(table)
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    assert "content" not in pieces.number_pieces(parts).columns + parts.columns


CODE = ["--- a/x.py", "+++ b/x.py", "--- a/y.cpp", "+++ b/y.cpp", "--- a/z.md", "+++ b/w.ts\tq", "@@ -1 +1 @@", "@@ -1,2 +3 @@ def h():",
        "+  a  b", "-a b", "+a b ", "-\ta\u00a0b", "+# c", "-// d", "+", "-  ", " def run(a):", "+class Late {", "-int f(int a) {", "+++ k",
        "---", "Binary files differ", "", "\\ No newline", "+* e", "+\"\"\" doc", "+function go() {", "+é = (a) => b", "+struct S {"]


@pytest.fixture(params=["short", "one line each", "long"])
def both(request, spark):
    """Whole patches and the same in pieces."""
    rng = random.Random(request.param)
    step = {"short": lambda: rng.randint(1, 7), "one line each": lambda: 1, "long": lambda: rng.randint(20, 90)}[request.param]
    whole, cut = [], []
    for p in range(30):
        weights = [3 if line.startswith(("@@", "+ ", "-a")) else 1 for line in CODE]
        lines = rng.choices(CODE, weights, k=110)
        end = rng.choice(["\n", "\r\n"])
        whole.append((str(p), end.join(lines) + end))
        number, at = 0, 0
        while at < len(lines):
            size = step()
            cut.append((str(p), number, end.join(lines[at:at + size]) + end))
            number, at = number + rng.randint(1, 2), at + size
    rng.shuffle(cut)
    files = parse_patches(spark.createDataFrame(whole, "patch_id string, content string"))
    return files, Pieces(spark.createDataFrame(cut, "patch_id string, piece_no long, content string").repartition(5))


def same(a, b, *columns):
    key = lambda r: tuple(str(x) for x in r)
    rows = [sorted((tuple(r) for r in t.select(*columns).collect()), key=key) for t in (a, b)]
    assert rows[0] == rows[1]
    return rows[0]


KEYS = ["patch_id", "file_seq"]


def test_hunks_over_pieces_equal_whole_hunks(both):
    files, own = both
    noise = same(
        with_noise_flags(hunk_table(files)), own.hunks, *KEYS, "hunk_seq", "path", "extension", "added", "deleted", "ws_only", "comment_only")
    assert any(r[-2] for r in noise) and any(r[-1] for r in noise) and not all(r[-1] for r in noise)
    for switches in ((True, True), (False, True), (True, False), (False, False)):
        same(with_meaningful(changed_only(files), *switches), own.meaningful(*switches), *KEYS, "n_hunks", "n_kept")
        assert same(file_tokens(files, *switches), own.file_tokens(*switches), *KEYS, "path", "chars", "tokens")


def test_symbols_over_pieces_equal_whole_symbols(both):
    files, own = both
    assert len(same(symbol_table(files), own.symbols(), *KEYS, "ord", "symbol")) > 50


def test_text_of_pieces_is_not_exchanged(spark):
    table = spark.createDataFrame([("p", 0, "--- a/x.py\n@@ -1 +1 @@\n+def a():\n")], "patch_id string, piece_no int, content string")
    plan = Pieces(table).symbols()._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and "content" not in " ".join(exchanged)


def test_no_pieces(spark):
    own = Pieces(spark.createDataFrame([], "patch_id string, piece_no int, content string"))
    assert own.hunks.count() == own.symbols().count() == own.file_tokens().count() == own.meaningful().count() == 0


def test_pieces_in_arrow_equal_the_columns(spark):
    """Parts that workers describe equal those of piece_parts; the text is read once for parts and hunks."""
    from diffloom.operators.piece_hunks import describe_pieces
    from diffloom.operators.pieces import part_sums, piece_parts

    rng = random.Random(8)
    odd = ["+++ b/late.py\tx", "+++ /dev/null", "Binary files a and b differ", "--- ", "+++ ", "++++", "----", "", "+\x0bx", "- y", "@@ -٣ +1 @@ z"]
    texts = ["\n".join(rng.choices(CODE + odd, k=rng.randint(0, 25))) + rng.choice(["", "\n", "\r\n"]) for _ in range(300)]
    rows = [(str(i % 40), i, text) for i, text in enumerate([*texts, None, "", "\n", "\n\n"])]
    table = spark.createDataFrame(rows, "patch_id string, piece_no long, content string")
    native, own = piece_parts(table), part_sums(describe_pieces(table).drop("states"))
    assert own.dtypes == native.dtypes
    assert sorted(map(str, own.collect())) == sorted(map(str, native.collect()))
