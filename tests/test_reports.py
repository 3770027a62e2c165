import json
import random
from pathlib import Path

import pytest

from patch_texts import patch
from pyspark.sql import functions as F

from diffloom.plans import documents, reports
from diffloom.plans.package import export_review_package, export_text_package
from diffloom.plans.reports import ReviewOptions

OPTIONS = ReviewOptions(source="unit", generated_at="2024-01-01 00:00:00")
TEXT = "\n".join([
    patch("low.py", ["def a():", "    return 1"]),
    patch("src/auth/x.py", [f"def f{i}():" for i in range(7)]),
    "--- a/i.bin\n+++ b/i.bin\nBinary files differ",
    patch("note.c", ["// only a comment"]),
    "--- a/same.py\n+++ b/same.py",
])


def rows(parse, options=OPTIONS, text=TEXT):
    return reports.review_rows(parse(text), options)


def test_summary(parse):
    row = reports.summaries(rows(parse), OPTIONS).first()
    lines = row.report.split("\n")
    assert lines[:4] == ["# AI Review — Summary", "", "> Generated: 2024-01-01 00:00:00", "> Source: unit"]
    assert "| Changed files | 3 |" in lines and "| Binary files  | 1 |" in lines
    table = lines[lines.index("## Changed Files") + 4:]
    assert table[0] == "| `src/auth/x.py` | +7 | -0 | 1 | `f0`, `f1`, `f2`, `f3`, `f4` +2 more | 🔴 High |"
    assert table[1] == "| `low.py` | +2 | -0 | 1 | `a` | 🟢 Low |"
    assert table[2] == "| `note.c` | +1 | -0 | 1 | — | 🟢 Low |"
    assert table[3:] == ["", "### Binary Files", "", "- `i.bin`"]


def test_changed_files(parse):
    assert reports.changed_file_lists(rows(parse)).first().report.split("\n") == [
        "# Changed Files", "",
        "[Med]    BINARY           i.bin",
        "[Low]    +2/-0            low.py",
        "[Low]    +1/-0            note.c",
        "[High]   +7/-0            src/auth/x.py",
    ]


def test_prompt(parse):
    prompt = reports.review_prompts(rows(parse), OPTIONS, "<<{diff_content}>>").first().prompt
    parts = prompt[2:-2].split("\n\n---\n\n")
    assert len(parts) == 2
    assert parts[1] == (
        "### FILE: low.py\nRisk: Low | +2/-0 LOC\nModified symbols: a\n\n"
        "```diff\n@@ -1,1 +1,1 @@\n+def a():\n+    return 1\n```")
    empty = reports.review_prompts(rows(parse, text="--- a/x\n+++ b/x"), OPTIONS, "{diff_content}").first().prompt
    assert empty == "(No meaningful diffs found)"
    stripped = ReviewOptions(strip_patch=True)
    text = reports.review_prompts(rows(parse, stripped), stripped).first().prompt
    assert text.startswith("NOTE:") and "def sym_" in text


def test_file_report(parse):
    table = reports.file_reports(rows(parse), OPTIONS).orderBy("file_seq").collect()
    assert [r.file_name for r in table] == ["low.py.diff.md", "src_auth_x.py.diff.md", "note.c.diff.md"]
    assert table[0].report == (
        "# `low.py`\n\n**Risk:** 🟢 Low  |  **+2** / **-0** LOC  |  **Hunks:** 1\n\n"
        "**Modified symbols:** `a`\n\n**Risk reasons:**\n- No specific risk signals detected\n\n"
        "## Diff\n\n```diff\n@@ -1,1 +1,1 @@\n+def a():\n+    return 1\n```\n")
    assert table[2].report.endswith("*No meaningful changes after filtering.*\n")


def test_json_and_arch_report(parse):
    files = parse(TEXT + "\n" + patch("z.py", ["import os"]))
    facts = reports.report_facts(files)
    table = reports.review_rows(files, OPTIONS)
    data = json.loads(reports.review_documents(table, facts, OPTIONS).first().document)
    assert [f["path"] for f in data["files"]] == ["low.py", "src/auth/x.py", "i.bin", "note.c", "z.py"]
    assert data["files"][1]["modified_symbols"] == [f"f{i}" for i in range(7)]
    assert data["architecture"]["dependency_changes"] == ["New dependency: `os`"]
    assert set(data["token_estimate"]) == {"total_tokens", "estimated_cost_usd"}
    report = reports.architecture_reports(facts, OPTIONS).first().report
    assert "## Module Dependency Changes\n\n- New dependency: `os`\n\n## Potential" in report
    assert "## New Components / Classes\n\n*None detected.*\n" in report


def test_patch_without_facts_keeps_its_report(parse):
    text = "--- a/i.bin\n+++ b/i.bin\nBinary files differ"
    report = reports.architecture_reports(reports.report_facts(parse(text)), OPTIONS).first().report
    assert "**Affected subsystems:** N/A" in report


def test_last_entry_of_a_path_decides(parse):
    text = patch("x.py", ["os.system(a)"]) + "\n" + patch("x.py", ["a = 1"])
    row = reports.summaries(rows(parse, text=text), OPTIONS).first()
    assert (row.high, row.med, row.low) == (0, 0, 1)
    assert row.report.count("🟢 Low |") == 2


def test_token_summary(parse):
    text = patch("big.py", ["x" * 7000]) + "\n" + patch("small.py", ["y"])
    lines = reports.token_summaries(rows(parse, text=text)).first().report.split("\n")
    assert lines[0] == "Estimated tokens : 2,009" and lines[1] == "Estimated cost   : $0.0100 (GPT-4o input ref)"
    assert lines[3:] == ["Top files by token count:", "   2,004  big.py", "       5  small.py"]


def test_four_decimals_like_python(spark):
    values = [t / 1000 * 0.005 for t in range(0, 4000)] + [0.00005, 0.00015, 1.00005, 123456.78905]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for row in table.select("v", reports.four_decimals(F.col("v")).alias("t")).collect():
        assert row.t == f"{row.v:.4f}", row.v


def test_package(spark, tmp_path):
    patches = spark.createDataFrame([("p1", TEXT), ("p2", patch("q.c", ["x"]))], "patch_id string, content string")
    paths = export_review_package(patches, str(tmp_path / "out"), OPTIONS)
    assert spark.read.parquet(paths["summary"]).count() == 2
    assert spark.read.parquet(paths["diffs"]).count() == 4
    assert {json.loads(r.value)["generated_at"] for r in spark.read.text(paths["review_data"]).collect()} == {
        "2024-01-01 00:00:00"}
    no_json = ReviewOptions(include_json=False)
    assert "review_data" not in export_review_package(patches, str(tmp_path / "two"), no_json)


def test_single_paths_pass_no_exchange(parse):
    one = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+a = 1\n"
    files = parse(one + "--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n+b = 1\n" + one)
    assert [r.path_repeats for r in files.orderBy("file_seq").collect()] == [True, False, True]
    rows = reports.review_rows(files)
    assert [r.is_last for r in rows.orderBy("file_seq").collect()] == [False, True, True]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    first, second = plan.split("Union", 1)[1].split("\n:- ", 1)[-1].split("\n+- ", 1)
    assert "Window" not in first and "Window" in second


LINES = ["class A {", "import os", "def f(self):", "public int G(int a) {", "// c", "std::mutex m;", "x = \"q\\\\\"", "export class V {", "é"]


@pytest.fixture
def many(spark):
    """Patches with few and many files, binary, identical and repeated ones."""
    rng = random.Random(9)
    texts = [TEXT, "--- a/i.bin\n+++ b/i.bin\nBinary files differ", "--- a/same\n+++ b/same"]
    for n in (1, 40):
        own = [patch(f"src/{'auth/' if i % 3 else ''}f{i % 30}.{rng.choice(['py', 'cpp', 'ts'])}",
                     rng.choices(LINES, k=6), rng.choices(LINES, k=3)) for i in range(n)]
        texts.append("\n".join(own))
    from diffloom.operators.parse import parse_patches

    return parse_patches(spark.createDataFrame([(f"p/{i}", x) for i, x in enumerate(texts)], "patch_id string, content string"))


WHOLE = {
    "summary": lambda rows, facts, o: reports.summaries(rows, o).select("patch_id", "report"),
    "changed_files": lambda rows, facts, o: reports.changed_file_lists(rows),
    "architecture_changes": lambda rows, facts, o: reports.architecture_reports(facts, o),
    "review_prompt": lambda rows, facts, o: reports.review_prompts(rows, o),
    "review_data": lambda rows, facts, o: reports.review_documents(rows, facts, o),
}
CHOICES = {
    "plain": OPTIONS,
    "all": ReviewOptions(facts_shown=None, dependencies_per_side=None, symbols_in_summary=None, signature_chars=None),
    "small": ReviewOptions(facts_shown=2, dependencies_per_side=1, strip_patch=True),
}


@pytest.mark.parametrize("choice", CHOICES)
def test_lines_in_order_are_the_document(many, choice):
    options = CHOICES[choice]
    rows, facts = reports.review_rows(many, options), reports.report_facts(many, options)
    for name, whole in WHOLE.items():
        lines = documents.report_lines(name, rows, facts, options)
        got = documents.joined(lines, "" if name == "review_data" else "\n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole(rows, facts, options).collect())), name
        assert not [r for r in lines.groupBy("patch_id").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.count("*").alias("n")).collect()
                    if (r.a, r.b) != (0, r.n - 1)]


def test_no_list_of_a_change_set_is_in_the_plans(many):
    rows, facts = reports.review_rows(many, OPTIONS), reports.report_facts(many, OPTIONS)
    for name in WHOLE:
        lines = documents.report_lines(name, rows, facts, OPTIONS)
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "listagg" not in plan


def test_text_package_of_a_comparison(spark, many, tmp_path):
    from diffloom.sources.snapshots import as_change_set

    files = as_change_set(many, "all of it")
    paths = export_text_package(files, str(tmp_path / "out"), OPTIONS)
    rows, facts = reports.review_rows(files, OPTIONS), reports.report_facts(files, OPTIONS)
    for name, whole in WHOLE.items():
        parts = sorted(Path(paths[name]).glob("patch_id=*/part-*.txt"))
        text = "".join(part.read_text() for part in parts)
        expected = whole(rows, facts, OPTIONS).first()[1]
        assert (text.replace("\n", "") if name == "review_data" else text[:-1]) == expected, name
    reports_ = {p.read_text() for p in Path(paths["diffs"]).rglob("*.diff.md")}
    assert reports_ == {r.report for r in reports.file_reports(rows, OPTIONS).collect()}
    assert "Estimated tokens" in next(Path(paths["token_estimate"]).rglob("part-*.txt")).read_text()


def test_texts_are_analysed_once(many):
    plan = reports.summaries(reports.review_rows(many, OPTIONS, hunks=False), OPTIONS)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "kept_hunks" not in plan


def test_top_tokens_are_limited_before_the_exchange(many):
    plan = reports.token_summaries(reports.review_rows(many, OPTIONS), OPTIONS)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
