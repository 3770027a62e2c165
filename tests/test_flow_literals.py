"""Rules of lines that are tried behind plain literals."""

from pyspark.sql import functions as F

from diffloom.operators.control_flow import _callee, non_source_line


def test_rules_of_lines_behind_literals(spark):
    noise = ["a.o(.text)", "x.y.o()", "Execution Region R", "Load Region", "***", "=====", "---", "Code Size",
             "Section Cross References", "RAM Totals", "it refers to x"]
    code = ["a.o", "-- -", "Size", "xReferences", "a Load Region", "f(x)", "ab(x)", "1abc (x)", "éabc(x) def_ (y)", ""]
    table = spark.createDataFrame([(x,) for x in noise + code], "s string")
    got = {r.s: (r.n, r.c) for r in table.select("s", non_source_line(F.col("s")).alias("n"), _callee(F.col("s")).alias("c")).collect()}
    assert [s for s in got if got[s][0]] == noise
    assert [got[s][1] for s in code] == ["", "", "", "", "", "", "", "", "def_", ""]
