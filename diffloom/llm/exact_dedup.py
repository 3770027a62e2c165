"""Exact duplicates through a stream with disk-backed keyed state.

The table is read as a stream.  Its state is keyed by the SHA-256 of the normalised
text and is kept by RocksDB in the checkpoint folder without expiry; for every digest
it holds the stable identifier that stays (largest id), the locator of a content (file
and row) and the number of rows.  Partial aggregation runs before the shuffle, so a
text that a third of all rows repeat reaches the state as one row per task.

A digest that more than one row has is a hit.  For hits the content at the state's
locator is read again and compared byte by byte with the content of every row of that
digest.  Rows whose bytes differ (a collision of SHA-256) form groups by their text.

Defined results: a null text counts as empty; empty texts are equal to each other;
rows repeated as a whole, id included, count as rows of the group and all of them say
``kept`` if their id stays; a null id does not stay unless all ids of the group are
null (then ``keep_id`` is null and all of them stay); other columns are ignored; an empty
table gives an empty result.  Normalisation lower-cases A-Z and nothing else.
"""

from __future__ import annotations

import string
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm.bitmap import KeyBitmap
from diffloom.storage import shared_folder, stored

STATE = "spark.sql.streaming.stateStore"
#: Preallocation takes some MB for each of many small stores, unbounded buffers too.
STATE_STORE = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.allowFAllocate": "false",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.maxMemoryUsageMB": "256",
}


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain ASCII texts take the faster function."""
    plain = F.length(text) == F.octet_length(text)
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(exact)


def normal_text(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stream_of(spark: SparkSession, path: str, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """File stream over a Parquet table, be it a folder or one file.

    A file stream takes folders and patterns, so the last letter is written as a
    pattern that only it matches.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
    whole = path.rstrip("/")
    return reader.parquet(f"{whole[:-1]}[{whole[-1]}]")


def _located(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = normal_text(F.col(text_col))
    return rows.select(
        F.col(id_col).alias("_id"),
        F.sha2(text.cast("binary"), 256).alias("_digest"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        ).alias("_at"),
        text.alias("_text"),
    )


def digest_state(stream: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Run the stream to its end; digest, keep_id, group_size, locator from its state."""
    spark = stream.sparkSession
    keyed = _located(stream, id_col, text_col).drop("_text")
    state = keyed.groupBy("_digest").agg(
        F.max("_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("_at").alias("at")
    )
    folder = shared_folder(spark)
    with _settings(spark, STATE_STORE):
        run = (
            state.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", folder).trigger(availableNow=True).start()
        )
        run.awaitTermination()
        held = spark.read.format("statestore").load(folder)
    # The buffers of the three aggregates, in their order.
    names = held.schema["value"].dataType.names
    keep_id, group_size, at = (F.col("value").getField(name) for name in names)
    return held.select(
        F.col("key").getField(held.schema["key"].dataType.names[0]).alias("_digest"),
        keep_id.alias("keep_id"),
        group_size.alias("group_size"),
        at.alias("at"),
    )


def exact_duplicates(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
    bytes_per_batch: int = 64 << 30,
) -> DataFrame:
    """One row per row of the table at ``path``: its id, keep_id, group_size, kept, text_sha256."""
    groups = stored(digest_state(stream_of(spark, path, bytes_per_batch), id_col, text_col))
    rows = _located(spark.read.parquet(path), id_col, text_col)

    hits = groups.where("group_size > 1").select("_digest", "at")
    hit = KeyBitmap(hits, "_digest").may_have("_digest")
    # Stored, texts are read once, and the next join can split a hot digest.
    texts = stored(rows.where(hit).join(hits, "_digest").select("_digest", "_at", "at", "_text"))
    held = texts.where(F.col("_at") == F.col("at")).select("_digest", F.col("_text").alias("held"))
    unequal = stored(
        texts.select("_digest", "_text").join(stored(held), "_digest")
        .where(F.col("_text") != F.col("held"))
        .select("_digest").distinct()
    )
    result = rows.join(groups, "_digest").select("_id", "_digest", "keep_id", "group_size")
    if not unequal.isEmpty():
        odd = rows.join(unequal, "_digest", "left_semi")
        by_text = stored(
            odd.groupBy("_digest", "_text").agg(
                F.max("_id").alias("keep_id"), F.count("*").alias("group_size")
            )
        )
        result = result.join(unequal, "_digest", "left_anti").unionByName(
            odd.join(by_text, ["_digest", "_text"]).select(*result.columns)
        )
    return result.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )
