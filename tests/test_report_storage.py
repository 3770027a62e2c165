"""Reports keep no stored table longer than it is read, and analyse each text once."""

from pathlib import Path

from diffloom.plans import documents, reports
from diffloom.storage import stored, stored_alone, tracked

PATCH = (
    "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+import os\n+def run(self, a):\n-class Old:\n+class New:\n"
    "--- a/y.js\n+++ b/y.js\n@@ -1 +1 @@\n+app.get('/a', b)\n"
    "--- a/x.py\n+++ b/x.py\n@@ -9 +9 @@\n+eval (1)\n"
)


def there(paths):
    return [path for path in paths if Path(path).exists()]


def test_tables_that_were_read_go(spark):
    with tracked() as paths:
        table = stored_alone(spark, lambda: stored(stored(spark.range(3))).selectExpr("id + 1 AS id"), "zstd")
    assert sorted(r.id for r in table.collect()) == [1, 2, 3]
    assert len(paths) == 3 and there(paths) == paths[-1:]


def test_documents_keep_their_sorted_lines_only(spark, parse):
    with tracked() as paths:
        lines = documents.lines_alone(
            spark, lambda: documents.prompt_entries(stored(reports.review_rows(parse(PATCH, "")), "zstd"))
        )
    assert len(paths) > 3 and len(there(paths)) == 1
    prompts = {r.patch_id: r.document for r in documents.joined(lines).collect()}
    want = {r.patch_id: r.prompt for r in reports.review_prompts(reports.review_rows(parse(PATCH, ""))).collect()}
    assert prompts == want and "class New" in prompts["p0"]


def test_one_pass_gives_rows_and_facts(spark, parse):
    files = parse(PATCH, PATCH.replace("x.py", "z.py"), "")
    with tracked() as paths:
        rows, facts = reports.review_tables(files)
    assert len(paths) == 1
    for got, want in ((rows, reports.review_rows(files)), (facts, reports.report_facts(files))):
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert facts.where("kind = 'dependency_change'").count() == 2
