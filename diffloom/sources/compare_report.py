"""XML compare reports: every ``item`` element of a folder comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions.dialect import SPACE
from diffloom.functions.rules import REPORT_STATUSES
from diffloom.operators.parse import finish_file_diffs

_ATTRIBUTES = ["leftfile", "rightfile", "status", "leftlines", "rightlines"]


def read_report_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw attributes of all items: ``report, item_no, leftfile, ... rightlines``.

    The schema is given, so no file is read to infer it.
    """
    schema = ", ".join(f"_{name} string" for name in _ATTRIBUTES)
    items = (
        spark.read.format("xml")
        .schema(schema)
        .option("rowTag", "item")
        .option("ignoreSurroundingSpaces", False)
        .load(path)
    )
    return items.select(
        F.col("_metadata.file_path").alias("report"),
        F.monotonically_increasing_id().alias("item_no"),
        *[F.coalesce(F.col(f"_{name}"), F.lit("")).alias(name) for name in _ATTRIBUTES],
    )


def _line_count(text: Column) -> Column:
    """``int(text)`` with null for what is no whole number."""
    number = rf"\A[{SPACE}]*[+-]?\d+(?:_\d+)*[{SPACE}]*\z"
    digits = F.regexp_replace(text, rf"[_{SPACE}]", "")
    return F.when(text.rlike(number), digits.try_cast("bigint"))


def report_file_diffs(items: DataFrame) -> DataFrame:
    """Report items as file entries; identical and unknown statuses are dropped.

    Known line counts give one placeholder hunk with at most one line per side.
    ``patch_id`` is the report and ``file_seq`` the item number.
    """
    status = F.lower("status")
    counted = items.where(status.isin(*REPORT_STATUSES)).select(
        "report",
        "item_no",
        "leftfile",
        "rightfile",
        (status == "binarydiffer").alias("binary"),
        _line_count(F.col("leftlines")).alias("old_lines"),
        _line_count(F.col("rightlines")).alias("new_lines"),
    )
    old, new = F.col("old_lines"), F.col("new_lines")
    note = F.concat_ws(
        "\n",
        F.when(new != 0, F.concat(F.lit("+["), new, F.lit(" lines in new file]"))),
        F.when(old != 0, F.concat(F.lit("-["), old, F.lit(" lines in old file]"))),
    )
    hunks = F.when(old.isNotNull() | new.isNotNull(), F.array(note)).otherwise(
        F.array().cast("array<string>")
    )
    return finish_file_diffs(
        counted.select(
            F.col("report").alias("patch_id"),
            F.col("item_no").alias("file_seq"),
            F.col("leftfile").alias("old_path"),
            F.col("rightfile").alias("new_path"),
            "binary",
            hunks.alias("hunks"),
        )
    )


def load_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return report_file_diffs(read_report_items(spark, path))
