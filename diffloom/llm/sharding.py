"""Records dealt to weighted shards by rendezvous hashing of a stable key.

Every shard draws a number for a key, from the MD5 digest of shard and key, and the
highest one takes the record: ``weight / -ln(u)`` with ``u`` in (0, 1) makes the chance
of a shard its share of the weights.  The draw of a shard knows nothing of the others,
so one more shard takes records only into itself, and a shard that goes only gives up its
own.  The choice is a projection of the row: no exchange, no state, and the same
answer in any engine that has MD5.

``with_slots`` numbers the records of each shard without a window over a shard: rows
are range-partitioned by (shard, key, ...), so a shard is spread over many tasks.

Defined results: a null key is one key of its own, different from the empty string; records with
the same key are in the same shard, whatever their texts; ties of the draws go to the
lower shard; a null text has no bytes; repeated rows are records of their own and take
slots next to each other; other columns are ignored by ``shard_table`` and kept by ``write_shards``,
which replaces an input column named ``shard``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.storage import numbered, stored

Weights = Mapping[int, float] | Sequence[float]
#: Hexadecimal digits of a digest that make a number; 52 bits are exact in a double.
DIGITS = 13


def _weights(weights: Weights) -> dict[int, float]:
    own = dict(weights) if isinstance(weights, Mapping) else dict(enumerate(weights))
    if not own or not all(math.isfinite(w) and w > 0 for w in own.values()):
        raise ValueError("weights must be positive numbers, one for each shard")
    return own


def draw(key: Column, shard: int) -> Column:
    """Number in (0, 1) of a shard for a key."""
    text = F.coalesce(F.concat(F.lit(f"{shard}:"), key.cast("string")), F.lit(str(shard)))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(16**DIGITS))


def rendezvous(key: Column, weights: Weights) -> Column:
    """Shard of a key; ``weights`` are those of shards 0, 1, ... or a map from shard to weight."""
    offers = [
        F.struct((F.lit(float(weight)) / -F.log(draw(key, shard))).alias("score"), F.lit(-shard).alias("minus"))
        for shard, weight in sorted(_weights(weights).items())
    ]
    # greatest() wants two values at least.
    return -F.greatest(*offers, offers[0])["minus"]


def with_slots(table: DataFrame, shard: str, *order: str) -> DataFrame:
    """Add ``slot``, the place of a row in its shard from 0 in the given order."""
    rows = numbered(table, shard, *order)
    starts = rows.groupBy(F.col(shard).alias("_of")).agg(F.min("number").alias("_first"))
    return rows.join(starts, F.col(shard) == F.col("_of")).withColumn(
        "slot", F.col("number") - F.col("_first")
    ).drop("number", "_of", "_first")


def shard_table(
    records: DataFrame, weights: Weights, grown: Weights | None = None,
    key_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One small row per record: key, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes and one for its end.  ``grown_shard`` is the shard
    under the weights ``grown``, null without them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(key_col)
    rows = records.select(
        key.alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Both are functions of the key alone, so they wait until texts are out of the row.
    dealt = stored(rows).select(
        "*",
        rendezvous(F.col("key"), weights).alias("shard"),
        (rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(stored(dealt), "shard", "key", "size", "text_crc32").withColumnRenamed("key", key_col)


def write_shards(
    records: DataFrame, weights: Weights, path: str, files: int = 1, key_col: str = "doc_id"
) -> None:
    """Write whole records below ``path`` as one folder per shard, ``shard=0`` and so on.

    A shard has about ``files`` files; a record's file is drawn like its shard, so copies of a
    key stay together and a shard is written by as many tasks as it has files.
    """
    file = rendezvous(F.concat(F.lit("file:"), F.col(key_col).cast("string")), [1.0] * files)
    shards = records.withColumn("shard", rendezvous(F.col(key_col), weights))
    tasks = len(_weights(weights)) * files
    (
        shards.repartition(tasks, "shard", file).sortWithinPartitions("shard", file, key_col)
        .write.partitionBy("shard").parquet(path)
    )


def moved_share(table: DataFrame) -> DataFrame:
    """shard, grown_shard, rows: how many records go where when the shards change."""
    return table.groupBy("shard", "grown_shard").agg(F.count("*").alias("rows"))


def expected_shares(weights: Weights) -> dict[int, float]:
    own = _weights(weights)
    total = reduce(float.__add__, map(float, own.values()))
    return {shard: weight / total for shard, weight in own.items()}
