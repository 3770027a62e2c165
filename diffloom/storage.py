"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """New folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used if driver and executors are one
    process; any other session is refused, because its executors would each write to
    their own disk and later reads would miss rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="diffloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_TRACKED: list[list[str]] = []


@contextmanager
def tracked() -> Iterator[list[str]]:
    """Paths of the tables that :func:`stored` writes in this block, for :func:`remove`."""
    paths: list[str] = []
    _TRACKED.append(paths)
    try:
        yield paths
    finally:
        _TRACKED.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that no result still to be computed reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Shuffle files of a finished query are removed at once and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(table: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``table`` once and continue from the stored copy.

    This cuts the lineage, survives the loss of executors and gives Catalyst the
    true size, which decides whether a later join may broadcast it.  No later query reads
    the shuffle files of the write, so they go with it.  Tables with texts are best written with
    ``compression`` "zstd".
    """
    spark = table.sparkSession
    path = shared_folder(spark)
    for paths in _TRACKED:
        paths.append(path)
    with shuffles_removed(spark):
        table.write.parquet(path, compression=compression)
    return spark.read.schema(table.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], compression: str | None = None) -> DataFrame:
    """Store the table that ``make`` gives and remove the tables that it stored on the way."""
    with tracked() as made:
        table = make()
    result = stored(table, compression)
    remove(spark, made)
    return result


def with_place(ordered: DataFrame, *order: str, compression: str | None = None) -> DataFrame:
    """Store ``ordered`` in the given order; add ``_part`` and ``_index``.

    ``_part`` is the number of the range partition a row was written by and
    ``_index`` its row in that file, so ``(_part, _index)`` follows the order.  Rows
    that agree in all of ``order`` may stand in any order, and are split between
    partitions like others.
    """
    table = ordered.withColumn("_tie", F.monotonically_increasing_id())
    ranged = table.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    return stored(ranged, compression).select(
        *ordered.columns,
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("_part"),
        F.col("_metadata.row_index").alias("_index"),
    )


def numbered(table: DataFrame, *order: str, compression: str | None = None) -> DataFrame:
    """Store ``table`` sorted and add ``number``, its place in that order from 0.

    The place of a row is its index in its range partition plus the rows of earlier
    partitions, so the only window is over one row per partition.
    """
    rows = with_place(table, *order, compression=compression)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    placed = rows.join(starts, "_part")
    return placed.withColumn("number", F.col("_start") + F.col("_index")).drop(
        "_part", "_index", "_start"
    )
