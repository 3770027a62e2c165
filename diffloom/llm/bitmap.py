"""Bitmaps of bounded size that keep rows without a partner out of a shuffle.

The keys of a small table set bits at their hash; rows of a large table whose bit is not
set cannot have a partner.  Rows with a set bit may have one, so the join still decides.
The bitmap has a fixed number of bits (1 MB by default) whatever the tables hold; with
more keys it lets more rows through and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_BUCKET = 8 * 4096


def bitmap_buckets(keys: int, most: int = 256) -> int:
    """Buckets with about 16 bits for each of so many keys."""
    return min(most, keys * 16 // PER_BUCKET + 1)


class KeyBitmap:
    """Bits of the hashes of ``keys``."""

    def __init__(self, table: DataFrame, *keys: str, buckets: int = 256) -> None:
        self.buckets = buckets
        place = self._place([F.col(k) for k in keys])
        rows = (
            table.select((F.floor(place / PER_BUCKET)).cast("int").alias("b"), F.pmod(place, F.lit(PER_BUCKET)).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
        )
        parts = {row.b: bytes(row.bits) for row in rows}
        self.bits = [parts.get(b, bytes(PER_BUCKET // 8)) for b in range(buckets)]

    def _place(self, keys: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets * PER_BUCKET))

    def may_have(self, *keys: Column | str) -> Column:
        columns = [F.col(k) if isinstance(k, str) else k for k in keys]
        place = self._place(columns)
        bits = F.element_at(
            F.array(*[F.lit(b) for b in self.bits]), (F.floor(place / PER_BUCKET) + 1).cast("int")
        )
        inside = F.pmod(place, F.lit(PER_BUCKET))
        byte = F.substring(bits, (F.floor(inside / 8) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.getbit(value, F.pmod(inside, F.lit(8)).cast("int")) == 1
