"""The derived patches."""

from diffloom.workload import fixtures


def test_patch_text_follows_the_formulas():
    assert fixtures.patch_text(3, ["one", "{i}", "two", "three"]) == (
        "--- a/util3_0.md\n+++ b/util3_0.md\t2024-05-01\n@@ -1 +1 @@ one\n"
        " int Widget::count0(const int a) const {\n+function do1(a) {\n"
        " const arrow2 = (a, b) => a + b;\n-export default function main3() {\n"
    )
    assert fixtures.patch_text(7, ["a", "b"]).endswith('@@ a\n-emit("a");\n+dispatch(act1);')


def test_patches_of_odd_rows_pass_no_interpreted_lambdas(spark, tmp_path):
    rows = [(1, None), (None, "a b"), (6, ""), (7, "a\n b"), (7, "a\n b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    patches = fixtures.synthetic_patches(spark, str(tmp_path))
    # Word by word in lambdas, building took most of the time of every patch query.
    assert "lambda" not in patches._jdf.queryExecution().toString()
    found = {(row.patch_id, row.content) for row in patches.collect()}
    assert patches.count() == 5 and len(found) == 4
    assert found == {
        ("1", None), (None, ""), ("6", fixtures.patch_text(6, [""])), ("7", fixtures.patch_text(7, ["a", "b"]))
    }
