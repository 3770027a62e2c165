from patch_texts import patch

from diffloom.operators import architecture as arch
from diffloom.operators.risk import file_risk, risk_histogram, riskiest_files
from diffloom.operators.statistics import (
    file_tokens,
    patch_tokens,
    path_breakdown,
    patch_totals,
    token_breakdown,
)
from diffloom.operators.symbols import symbol_table


def risk(parse, *texts):
    return [(r.score, r.level, r.reasons) for r in file_risk(parse(*texts)).orderBy("patch_id", "file_seq").collect()]


def test_risk_paths_and_defaults(parse):
    results = risk(
        parse,
        patch("src/auth/login.cpp", ["x = 1"]),
        patch("src/utils.py", ["x = 1"]),
        patch("tools/release.sh", ["x"]),
        patch("src/tables.py", [f"x{i} = 1" for i in range(417)]),
        patch("src/auth/SessionManager.cpp", ["std::mutex m;"]),
    )
    assert results[0] == (4, "High", ["High-risk path segment: 'auth'"])
    assert results[1] == (0, "Low", ["No specific risk signals detected"])
    assert results[2] == (3, "Med", ["Sensitive file type: .sh"])
    assert results[3] == (3, "Med", ["Large change (417 LOC modified)"])
    assert results[4][:2] == (7, "High")


def test_risk_content_first_rule_wins_and_crosses_lines(parse):
    first, second = risk(
        parse,
        patch("a.py", ["import subprocess", "os.system(x)"]),
        patch("a.py", ["y = eval", "", "  (x)"]),
    )
    assert first[2] == [r"Dangerous pattern: `\bos\.system\b`"]
    assert second[2] == [r"Dangerous pattern: `\beval\s*\(`"]


def test_risk_hunks_binary_and_ranking(parse):
    hunks = "\n".join(f"@@ -{i} +{i} @@\n+x{i}" for i in range(1, 13))
    text = (
        "--- a/big.py\n+++ b/big.py\n" + hunks
        + "\n--- a/i.bin\n+++ b/i.bin\nBinary files differ\n" + patch("a.c", ["z"])
    )
    table = file_risk(parse(text))
    rows = riskiest_files(table, 2).orderBy("rank").collect()
    assert [(r.path, r.score) for r in rows] == [("big.py", 2), ("i.bin", 2)]
    assert risk_histogram(table).first()[1:] == (0, 2, 1)


def test_symbols(parse):
    text = (
        "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+def foo():\n class Ctx:\n@@ -9 +9 @@\n-def foo():\n+async def bar(a):\n"
        "--- a/x.ts\n+++ b/x.ts\n@@ -1 +1 @@\n+const go = async (a) => 1\n+  run(x)\n"
        "--- a/x.xyz\n+++ b/x.xyz\n@@ -1 +1 @@\n+def foo():\n"
        "--- a/x.cpp\n+++ b/x.cpp\n@@ -1 +1 @@ class Outer\n+int Foo::count(const int a) const {\n+struct éclair {\n"
    )
    rows = symbol_table(parse(text)).orderBy("file_seq", "ord").collect()
    assert [(r.file_seq, r.symbol) for r in rows] == [
        (1, "foo"), (1, "Ctx"), (1, "bar"), (2, "go"), (2, "run"), (4, "éclair")]


def facts(parse, text, *kinds):
    rows = arch.arch_facts(parse(text)).where(arch.F.col("kind").isin(*kinds)).orderBy("kind", "ord").collect()
    return [r.text for r in rows]


def test_components(parse):
    text = patch("a.py", ["class New:", ""], ["class GridWalker:"]) + "\n class Late:\n"
    text = text.replace("+\n-class GridWalker:", "-class GridWalker:\n+")
    assert facts(parse, text, arch.NEW) == ["`New` in `a.py`", "`Late` in `a.py`"]
    assert facts(parse, text, arch.REMOVED) == ["`GridWalker` from `a.py`"]


def test_dependencies_cancel_over_files(parse):
    text = "\n".join([
        patch("a.py", ["import polyline", "import moved"], ["import shapefmt"]),
        patch("b.js", ["const a = require('tilekit')"], ["import moved"]),
        patch("c.cpp", ['#include "Raster.h"']),
    ])
    assert facts(parse, text, arch.DEPENDENCY) == [
        "New dependency: `Raster.h`", "New dependency: `polyline`", "New dependency: `tilekit`",
        "Removed dependency: `shapefmt`"]


def test_dependencies_are_complete_and_side_effects(parse):
    text = patch("Map/a.py", [f"import m{i:02d}" for i in range(25)] + ["std::mutex lock;", "malloc(4);"])
    assert len(facts(parse, text, arch.DEPENDENCY)) == 25
    assert facts(parse, text, arch.SIDE_EFFECT) == [
        "25 new dependencies introduced — check for conflicts.",
        "New concurrency code increases risk of race conditions or deadlocks.",
        "Direct memory management changes may introduce leaks or UB."]
    assert facts(parse, text, arch.CONCURRENCY) == ["`Map/a.py` introduces concurrency primitives"]


def test_api_changes_and_subsystems(parse):
    text = patch("Map/a.cs", ["public int Get(int a)", "[HttpGet]"], ["public int Get(int a)"]) + "\n" + patch(
        "UI/w.py", ["def run(self, a):", "public int Get(int a)"])
    assert facts(parse, text, arch.API) == [
        "Added in `Map/a.cs`: `public int Get(`", "Removed from `Map/a.cs`: `public int Get(`",
        "Added in `Map/a.cs`: `[HttpGet]`", "Added in `UI/w.py`: `def run(self`"]
    assert facts(parse, text, arch.SUBSYSTEM) == ["Map", "UI"]


def test_tokens_and_last_wins(parse):
    one = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+" + "a" * 100
    two = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+" + "b" * 30
    tokens = file_tokens(parse(one + "\n" + two + "\n" + patch("y.py", ["c"])))
    sizes = [len("@@ -1 +1 @@\n+") + n for n in (100, 30)]
    rows = tokens.orderBy("file_seq").collect()
    assert [(r.chars, r.tokens) for r in rows[:2]] == [(n, int(n / 3.5)) for n in sizes]
    total = patch_tokens(tokens).first()
    assert total.total_chars == sum(r.chars for r in rows)
    assert total.total_tokens == rows[1].tokens + rows[2].tokens
    assert total.cost_usd == total.total_tokens / 1000 * 0.005
    assert token_breakdown(tokens).first().breakdown == {"x.py": rows[1].tokens, "y.py": rows[2].tokens}
    assert path_breakdown(tokens).where("path = 'x.py'").first().first_seq == 1


def test_totals(parse):
    text = patch("a.py", ["x"], ["y", "z"]) + "\n--- a/i\n+++ b/i\nBinary files differ\n--- a/s\n+++ b/s\n"
    assert patch_totals(parse(text)).first() == ("p0", 1, 1, 1, 2)


def test_signatures_differ_beyond_any_prefix(parse):
    head = "public int " + "A" * 90
    text = patch("a.cs", [head + "One(int a)", head + "Two(int a)"])
    assert len(facts(parse, text, arch.API)) == 2
    cut = arch.marked_facts(parse(text), signature_chars=80).where("kind = 'api_change'")
    assert cut.count() == 1


def test_only_wanted_patterns_are_in_the_plan(parse):
    files = parse(patch("a.py", ["import m", "class New:"]))
    wanted = arch.arch_facts(files, [arch.DEPENDENCY])
    plan = wanted._jdf.queryExecution().optimizedPlan().toString()
    assert "import" in plan and "class" not in plan.replace("classes", "") and "mutex" not in plan
    assert [r.text for r in wanted.collect()] == ["New dependency: `m`"]
    whole = arch.arch_facts(files).where("kind = 'dependency_change'")
    assert whole.collect() == wanted.collect()


def test_rule_tables_hold_all_entries():
    from diffloom.functions import rules

    sizes = {
        name: len(getattr(rules, name))
        for name in ("API_PATTERNS", "IMPORT_PATTERNS", "EVENT_PATTERNS", "CONTROL_WORDS", "SYMBOL_PATTERNS")
    }
    assert sizes["API_PATTERNS"] == 7 and sizes["EVENT_PATTERNS"] == 6 and sizes["SYMBOL_PATTERNS"] == 7
    assert rules.EVENT_PATTERNS[-1][1] == "Emit" and "sizeof" in rules.CONTROL_WORDS
