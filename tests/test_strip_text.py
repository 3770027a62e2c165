"""Stripped tables of hunks, rewritten in Arrow batches, equal the columns that rewrite one hunk."""

import random

from pyspark.sql import functions as F

from diffloom.operators.redaction import API_SAFE, API_SAFE_COMMENTS, FULL, strip_files, strip_hunk, strip_texts

PARTS = [
    "+", "-", " ", "+++", "---", "\t", " ", "if", "return", "x", "fooBar", "FooBar", "MAX_X", "get_it", "café", "数", "٣",
    "0", "1", "-1", "42", "3.14f", "1e-5", "10.0.0.1", "a1", ".5", "'", '"', "\\", "\\\"", "f'b'", "____STR_1____", "____x____", "____",
    "//", "#", "/*", "*/", "'''", '"""', "(", ")", "{", ";", ",", "=", "-5", "- 7", "￿", "😀", "x_1", "_", "½", "²",
]


def hunks(count):
    rng = random.Random(31)
    for i in range(count):
        lines = ["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        lines = [rng.choice(["+", "-", " ", " ", ""]) + line for line in lines]
        yield "\n".join([*(["@@ -1 +1 @@ f(" + rng.choice(PARTS)] if rng.random() < 0.9 else []), *lines])


def test_batches_equal_columns(spark):
    rows = [(f"p{i}", i, rng_path, [h, h + "\n+tail"]) for i, h in enumerate(hunks(400)) for rng_path in ("a.c",)]
    rows += [("n", 0, "a.c", None), (None, 1, "b.c", []), ("h", 2, "b.c", ["+x9 = 'a'", ""])]
    table = spark.createDataFrame(rows, "patch_id string, file_seq int, path string, kept_hunks array<string>")
    for mode, width, strict in ((FULL, 1, False), (API_SAFE, 0, True), (API_SAFE_COMMENTS, 1, False), (API_SAFE_COMMENTS, 0, True)):
        one = table.select("patch_id", "file_seq", "path", F.posexplode("kept_hunks").alias("pos", "hunk"))
        native = one.select(
            "patch_id", "file_seq", (F.col("pos") + 1).alias("hunk_seq"),
            F.posexplode(strip_hunk(F.col("hunk"), F.col("path"), mode, width, strict)).alias("ord", "text"),
        )
        got = strip_files(table, mode, width, strict)
        assert got.dtypes == native.dtypes
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in native.collect()}
        texts = table.select("file_seq", "patch_id", strip_texts(F.col("kept_hunks"), F.col("path"), mode, width, strict).alias("t"))
        joined = one.select("file_seq", "patch_id", "pos", F.array_join(strip_hunk(F.col("hunk"), F.col("path"), mode, width, strict), "\n"))
        flat = {(r[0], r[1], i, t) for r in texts.collect() for i, t in enumerate(r.t or [])}
        assert flat == {tuple(r) for r in joined.collect()}


def test_stripped_tables_leave_the_lambdas(spark):
    table = spark.createDataFrame([("p", 1, "a.c", ["@@ -1 +1 @@\n+x"])], "patch_id string, file_seq int, path string, kept_hunks array<string>")
    plan = strip_files(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
