"""Comments that are searched behind plain literals."""

from pyspark.sql import functions as F

from diffloom.operators.redaction import API_SAFE_COMMENTS, _block_marked, pseudonymize_line


def test_comments_stay_behind_literals(spark):
    lines = ["+  x1 /* keep me */ y1", "-z1 // tail", " '''doc''' + name", ' """doc""" # end', "+plain / name", ""]
    table = spark.createDataFrame([(x,) for x in lines], "s string")
    rows = table.select(
        "s", pseudonymize_line(F.col("s"), F.lit("p"), API_SAFE_COMMENTS).alias("t"), _block_marked(F.col("s")).alias("b")
    ).collect()
    kept = ["/* keep me */", "// tail", "'''doc'''", '"""doc"""', "", ""]
    assert [r.b for r in rows] == [True, False, True, True, False, False]
    assert all(k in r.t and "name" not in r.t for r, k in zip(rows, kept))
