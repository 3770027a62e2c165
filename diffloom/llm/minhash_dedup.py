"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct shingles of ``words`` consecutive words.  For a
table key of ``2 * half`` minhashes, ordinary banding computes as many minhashes per
table.  Here two collections of ``keys`` half keys (``half`` minhashes each) are computed,
and each pair of a left and a right half key is the key of a table: ``keys ** 2`` tables
from ``2 * keys * half`` minhashes.  A pair of similarity s is missed with a chance of
about ``1 - (1 - (1 - s ** half) ** keys) ** 2``: at the default (3, 12) and s = 0.8 that
is 0.0004, at 0.85 0.00002.  More documents than about 10^9 call for ``half = 4, keys = 20``.

Documents that share a key are candidates; ``bucket_components`` decides which pairs are
verified, and links are confirmed on full shingle sets.

Defined results: A-Z are lower-cased and words are runs of bytes other than
white space (``[^\\x20\\x09-\\x0D]+``); a text with fewer words is one shingle; null texts
and texts without words have 0 shingles and are linked with nothing; texts with the same
words are one class, so copies and repeated rows cost one row each; a null identifier
takes no part in a class (component null, kept); rows that share an identifier are one
document for links, which the greatest of their texts confirms; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.bitmap import KeyBitmap
from diffloom.llm.candidates import bucket_components, shared_buckets
from diffloom.storage import stored

SIGNATURE = "id long, n_shingles long, digest binary, halves array<long>, sketch array<long>"
#: Bits of a sketch, in which the hash of each shingle sets one.
SKETCH_BITS = 2048


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n))))


class Signer:
    """Half keys of shingle sets; words are hashed once per task."""

    def __init__(self, n: int, half: int, keys: int, seed: int = 7) -> None:
        self.n, self.half, self.keys = n, half, keys
        rng = np.random.default_rng(seed)
        count = 2 * keys * half
        self.factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.addends = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        self.mixers = rng.integers(1, 1 << 63, max(n, half), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.hashes: dict[bytes, int] = {}

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles."""
        if len(self.hashes) > 2_000_000:
            self.hashes.clear()
        known = self.hashes
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(words))
        mixed = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            part = own[i : len(own) - width + 1 + i] * self.mixers[i]
            mixed += part ^ (part >> np.uint64(29))
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed * self.mixers[0])

    def halves(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096, None] * self.factors + self.addends
            part ^= part >> np.uint64(31)
            part *= self.mixers[0]
            np.minimum(least, part.min(axis=0), out=least)
        rows = least.reshape(2 * self.keys, self.half)
        mixed = np.zeros(len(rows), np.uint64)
        for i in range(self.half):
            mixed = (mixed ^ (rows[:, i] >> np.uint64(30))) * self.mixers[i] + rows[:, i]
        return mixed


def sketch(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[shingles % np.uint64(SKETCH_BITS)] = 1
    return np.packbits(bits).view(np.int64)


def signatures(
    docs: DataFrame, id_col: str, text_col: str, n: int, half: int, keys: int
) -> DataFrame:
    """id, n_shingles, digest of the word sequence, 2 * keys half keys, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n, half, keys)
        for batch in batches:
            sizes, digests, halves, sketches = [], [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                if not words:
                    sizes.append(0), digests.append(None), halves.append([]), sketches.append([])
                    continue
                shingles = signer.shingles(words)
                sizes.append(len(shingles))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                halves.append(signer.halves(shingles).view(np.int64))
                sketches.append(sketch(shingles))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(halves, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "digest", "halves", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sign, SIGNATURE)


def table_keys(representatives: DataFrame, keys: int) -> DataFrame:
    """key, node: one row per table, a pair of a left and a right half key."""
    sides = representatives.select(
        "node",
        F.slice("halves", 1, keys).alias("left"),
        F.slice("halves", keys + 1, keys).alias("right"),
    )
    lefts = sides.select("node", "right", F.posexplode("left").alias("i", "u"))
    both = lefts.select("node", "i", "u", F.posexplode("right").alias("j", "v"))
    return both.select(F.xxhash64("i", "u", "j", "v").alias("key"), "node")


def verified(texts: DataFrame, n: int, similarity: Fraction, block: int = 32, share: int = 4096):
    """Check of candidates on the full shingle sets of ``texts(node, text)``.

    Leaders are dealt into blocks.  A task holds the sets of one block's leaders and the
    texts compared with them stream past, each once for a block and not once for a pair.
    Blocks that more than ``share`` texts meet are worked on in several parts.
    """

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sets = None, {}
        for frame in frames:
            links = []
            columns = (frame[c] for c in ("block", "part", "side", "node", "leaders", "text"))
            for block_no, part, side, node, leaders, text in zip(*columns):
                if (block_no, part) != key:
                    key, sets = (block_no, part), {}
                own = shingle_set(words_of(text), n)
                if side == 0:
                    sets[node] = own
                    continue
                for leader in leaders:
                    both = len(own & sets[leader])
                    union = len(own) + len(sets[leader]) - both
                    if both * similarity.denominator >= similarity.numerator * union:
                        links.append((min(node, leader), max(node, leader)))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    def verify(candidates: DataFrame, leaders: DataFrame) -> DataFrame:
        led = stored(leaders)
        blocks = max(1, -(-led.count() // block))

        def block_of(node):
            return F.pmod(F.xxhash64(node, F.lit(3)), F.lit(blocks))

        met = candidates.select(
            "node", "leaders", F.explode(F.array_distinct(F.transform("leaders", block_of))).alias("block")
        )
        rows = stored(
            met.select(
                "node", "block",
                F.filter("leaders", lambda leader: block_of(leader) == F.col("block")).alias("leaders"),
            )
        )
        parts = stored(
            rows.groupBy("block").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
        )
        heads = led.select("node", block_of(F.col("node")).alias("block")).join(parts, "block").select(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"),
            F.lit(0).alias("side"), "node", F.lit(None).cast("array<long>").alias("leaders"),
        )
        others = rows.join(parts, "block").select(
            "block", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"),
            F.lit(1).alias("side"), "node", "leaders",
        )
        partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = heads.unionByName(others).join(texts, "node").repartition(partitions, "block", "part")
        ordered = dealt.sortWithinPartitions("block", "part", "side")
        return ordered.mapInPandas(check, "a long, b long").distinct()

    return verify


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
    similarity: float = 0.8, half: int = 3, keys: int = 12,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (id = component_id)."""
    signed = stored(signatures(docs, id_col, text_col, words, half, keys))
    classes = stored(
        signed.where("digest is not null and id is not null").groupBy("digest").agg(
            F.min("id").alias("node"), F.first("n_shingles").alias("size"),
            F.first("halves").alias("halves"), F.first("sketch").alias("sketch"),
        )
    )
    shared = shared_buckets(table_keys(classes, keys), parts=16)
    sizes = classes.groupBy("node").agg(F.max("size").alias("size"))
    buckets = stored(shared.join(sizes, "node"))
    needed = stored(buckets.select("node").distinct())
    all_texts = docs.select(
        F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")
    )
    there = KeyBitmap(needed, "node").may_have("node")
    texts = stored(
        all_texts.where(there).join(needed, "node", "left_semi").groupBy("node")
        .agg(F.max("text").alias("text"))
    )
    exact = Fraction(similarity).limit_denominator(10_000)
    # Rows that share an identifier may have several word sequences; the sketch of one of them
    # says nothing of the text that confirms links, so such rows have none.
    one = classes.groupBy("node").agg(F.count("*").alias("_n"), F.first("sketch").alias("sketch"))
    sketches = stored(one.select("node", F.when(F.col("_n") == 1, F.col("sketch")).alias("sketch")))
    labels = bucket_components(buckets, verified(texts, words, exact), similarity, sketches=sketches)
    of_class = classes.select("digest", "node")
    if labels is not None:
        of_class = of_class.join(labels, "node", "left")
    else:
        of_class = of_class.withColumn("component", F.lit(None).cast("long"))
    of_class = stored(of_class.select("digest", F.coalesce("component", "node").alias("component_id")))
    own = F.coalesce("component_id", "id")
    return signed.select("id", "n_shingles", "digest").join(of_class, "digest", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
