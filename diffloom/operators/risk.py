"""Rule-based risk score per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.rules import (
    DANGEROUS_CONTENT,
    ELEVATED_PATHS,
    HIGH_RISK_PATHS,
    NOTABLE_CONTENT,
    RISK_ICONS,
    SENSITIVE_EXTENSIONS,
)
from diffloom.functions.text import first_match, matches
from diffloom.operators.parse import changed_only, changed_text


def first_path_rule(path: Column, patterns: list[str]) -> Column:
    lowered = F.lower(path)
    return first_match([(p, matches(lowered, p, "i")) for p in patterns])


def first_content_rule(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return first_match([(p, matches(text, p, flags)) for p, flags in patterns])


def with_risk(files: DataFrame) -> DataFrame:
    """Add ``score``, ``level`` and ``reasons`` to a file table."""
    staged = files.withColumn("_changed", changed_text(F.col("body"))).select(
        "*",
        (F.col("added") + F.col("deleted")).alias("_loc"),
        first_path_rule(F.col("path"), HIGH_RISK_PATHS).alias("_high"),
        first_path_rule(F.col("path"), ELEVATED_PATHS).alias("_elevated"),
        first_content_rule(F.col("_changed"), DANGEROUS_CONTENT).alias("_danger"),
        _hits(F.col("_changed")).alias("_notable"),
    )
    loc, hunks, ext = F.col("_loc"), F.col("n_hunks"), F.col("extension")
    sensitive = ext.isin(*SENSITIVE_EXTENSIONS)
    points = [
        F.when(loc > 300, 3).when(loc > 100, 1),
        F.when(hunks > 10, 2).when(hunks > 5, 1),
        F.when(F.col("_high").isNotNull(), 4),
        F.when(F.col("_elevated").isNotNull(), 2),
        F.when(F.col("_danger").isNotNull(), 3),
        F.col("_notable"),
        F.when(F.col("binary"), 2),
        F.when(sensitive, 3),
    ]
    reasons = [
        F.when(loc > 300, F.format_string("Large change (%d LOC modified)", loc)).when(
            loc > 100, F.format_string("Moderate change (%d LOC modified)", loc)
        ),
        F.when(hunks > 10, F.format_string("Scattered changes (%d hunks)", hunks)),
        F.concat(F.lit("High-risk path segment: '"), F.col("_high"), F.lit("'")),
        F.concat(F.lit("Risk-elevated path: '"), F.col("_elevated"), F.lit("'")),
        F.concat(F.lit("Dangerous pattern: `"), F.col("_danger"), F.lit("`")),
        F.when(F.col("binary"), F.lit("Binary file changed")),
        F.when(sensitive, F.concat(F.lit("Sensitive file type: ."), ext)),
    ]
    scored = staged.select(
        "*",
        sum((F.coalesce(p, F.lit(0)) for p in points), F.lit(0)).alias("score"),
        F.array_compact(F.array(*reasons)).alias("_reasons"),
    )
    nothing = F.array(F.lit("No specific risk signals detected"))
    return scored.select(
        *files.columns,
        "score",
        risk_level(F.col("score")).alias("level"),
        F.when(F.size("_reasons") == 0, nothing).otherwise(F.col("_reasons")).alias("reasons"),
    )


def _hits(text: Column) -> Column:
    hits = [matches(text, p, flags).cast("int") for p, flags in NOTABLE_CONTENT]
    return sum(hits[1:], hits[0])


def risk_level(score: Column) -> Column:
    return F.when(score >= 4, "High").when(score >= 2, "Med").otherwise("Low")


def risk_icon(level: Column) -> Column:
    icon = F.when(level.isNull(), F.lit("⚪"))
    for name, mark in RISK_ICONS.items():
        icon = icon.when(level == name, F.lit(mark))
    return icon.otherwise(F.lit("⚪"))


def file_risk(files: DataFrame) -> DataFrame:
    """``patch_id, file_seq, path, score, level, reasons`` of changed entries."""
    return with_risk(changed_only(files)).select(
        "patch_id", "file_seq", "path", "score", "level", "reasons"
    )


def riskiest_files(risk: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` files with the highest score of every patch, ties in input order."""
    order = Window.partitionBy("patch_id").orderBy(F.desc("score"), "file_seq")
    return risk.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def risk_histogram(risk: DataFrame) -> DataFrame:
    """Number of High, Med and Low files per patch, zeros included."""
    return risk.groupBy("patch_id").agg(
        *[F.count_if(F.col("level") == name).alias(name.lower()) for name in ("High", "Med", "Low")]
    )
