"""Distinct-word work over whole texts: split once, work once per distinct word, put back.

``word_rows`` turns the documents of a task into blocks.  A block is a bounded number of
characters of text (one longer text is a block of its own).  It becomes a layout row, with
the positions of its pre-tokens by document, and one row per word bucket, with the block's
distinct pre-tokens whose hash falls into the bucket, in byte order.  ``per_word`` brings
the rows of a bucket together, so each distinct word of the corpus is worked on once,
however many blocks have it.  ``per_block`` brings the results and the layout of a block
together.

A task of ``word_rows`` or ``per_block`` holds one block.  ``per_word`` streams rows and
remembers words up to a bound; beyond it the memory starts anew, which costs work on words
met again and changes no result.  The number of buckets is that of shuffle partitions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "block long, bucket int, data binary"
NAMES = ["block", "bucket", "data"]
KINDS = [pa.int64(), pa.int32(), pa.binary()]
#: Match this many pre-tokens at a time, so that a very long text is never one list.
STRIDE = 1_000_000
REMEMBERED = 1_000_000


def pieces_of(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    if len(text) < 4 * STRIDE:
        yield pattern.findall(text)
        return
    matches = (m.group() for m in pattern.finditer(text))
    while part := list(islice(matches, STRIDE)):
        yield part


def packed(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays; bytes of equal place stand together, which compresses better."""
    sizes = np.array([len(arrays), *map(len, arrays)], np.uint32)
    parts = [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in (sizes, *arrays)]
    return zstandard.compress(b"".join(parts), 3)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, arrays = np.frombuffer(zstandard.decompress(data), np.uint8), 0, []

    def take(n: int) -> np.ndarray:
        nonlocal at
        part = raw[at : at + 4 * n].reshape(4, n).T.copy().view("<u4").reshape(-1)
        at += 4 * n
        return part

    # The sizes are an array themselves, of unknown length: its first plane starts with it.
    n = int(raw[0])
    for size in take(n + 1)[1:]:
        arrays.append(take(int(size)))
    return arrays


def packed_bytes(items: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    head = packed(lengths)
    return len(head).to_bytes(4, "little") + head + zstandard.compress(b"".join(items), 3)


def unpacked_bytes(data: bytes) -> list[bytes]:
    at = 4 + int.from_bytes(data[:4], "little")
    (lengths,) = unpacked(data[4:at])
    blob = zstandard.decompress(data[at:])
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


class _Block:
    def __init__(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None, pattern: regex.Pattern) -> None:
        self.ids.append(doc_id)
        length = 0
        for words in pieces_of(pattern, text or ""):
            part = np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words))
            length += len(part)
            self.parts.append(part)
        self.lengths.append(length)
        self.size += len(text or "") + 64

    def rows(self, name: int, buckets: int) -> pa.RecordBatch:
        words = [w.encode() for w in self.numbers]
        tokens = np.concatenate([*self.parts, np.zeros(0, np.uint32)])
        by_bytes = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        hashes = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % buckets
        order = by_bytes[np.argsort(hashes[by_bytes], kind="stable")]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))

        # Words met once are a zero and their places in text order, others their frequency
        # rank from 1, which keeps the positions small.
        frequency = np.bincount(tokens, minlength=len(words))
        often = np.flatnonzero(frequency > 1)
        often = often[np.argsort(-frequency[often], kind="stable")]
        rank = np.zeros(len(words), np.int64)
        rank[often] = np.arange(1, len(often) + 1)
        codes = rank[tokens]
        known = np.array([i is not None for i in self.ids], np.uint32)
        values = np.array([i or 0 for i in self.ids], np.int64).view(np.uint32)
        layout = packed(
            np.array(self.lengths, np.uint64).view(np.uint32), known, values, codes,
            place[often], place[tokens[codes == 0]],
        )
        rows = [(name, -1, layout)]
        cuts = np.searchsorted(hashes[order], np.arange(buckets + 1)).tolist()
        ordered = [words[i] for i in order.tolist()]
        rows += [
            (name, b, packed_bytes(ordered[lo:hi]))
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo
        ]
        return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows), KINDS)], NAMES)


def partitions(table: DataFrame) -> int:
    return int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_rows(
    docs: DataFrame, id_col: str, text_col: str, pattern: str, block_chars: int = 28 << 20
) -> DataFrame:
    buckets = partitions(docs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        names = count(TaskContext.get().partitionId() << 32)
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py(), compiled)
                if block.size >= block_chars:
                    yield block.rows(next(names), buckets)
                    block = _Block()
        if block.ids:
            yield block.rows(next(names), buckets)

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(split, ROWS)


def per_word(
    rows: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bytes]]]
) -> DataFrame:
    """Replace the words of every bucket row by their results, working once per distinct word.

    ``make()`` gets lists of new words in byte order and returns their results.  Layout rows pass.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results_of, bucket, known = make(), None, {}
        for batch in batches:
            data = batch.column(2).to_pylist()
            for i, number in enumerate(batch.column(1).to_pylist()):
                if number < 0:
                    continue
                if number != bucket or len(known) > REMEMBERED:
                    bucket, known = number, {}
                words = unpacked_bytes(data[i])
                new = [w for w in words if w not in known]
                known.update(zip(new, results_of(new)))
                data[i] = packed_bytes([known[w] for w in words])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(data, KINDS[2])], NAMES)

    # Layout rows are dealt by their block.
    key = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.xxhash64("bucket"))
    dealt = rows.withColumn("_key", key).repartition(partitions(rows), "_key")
    return dealt.sortWithinPartitions("bucket").select(*NAMES).mapInArrow(work, ROWS)


class Layout:
    """Documents of a block: ids, and for each of their pre-tokens the place of its result."""

    def __init__(self, data: bytes) -> None:
        lengths, known, values, codes, often, once = unpacked(data)
        self.lengths = lengths.view(np.uint64).astype(np.int64)
        self.ids = [
            value if there else None for value, there in zip(values.view(np.int64).tolist(), known)
        ]
        self.places = np.empty(len(codes), np.int64)
        self.places[codes > 0] = often[codes[codes > 0].astype(np.int64) - 1]
        self.places[codes == 0] = once
        ends = np.cumsum(self.lengths)
        self.bounds = list(zip((ends - self.lengths).tolist(), ends.tolist()))


def per_block(
    rows: DataFrame, finish: Callable[[Layout, list[bytes]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Rows of ``finish(layout, results)``; a pre-token's result is at its place in ``results``."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, results, name = None, [], None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                if block != name:
                    if layout is not None:
                        yield from finish(layout, results)
                    layout, results, name = Layout(data.as_py()), [], block
                else:
                    results += unpacked_bytes(data.as_py())
        if layout is not None:
            yield from finish(layout, results)

    dealt = rows.repartition(partitions(rows), "block").sortWithinPartitions("block", "bucket")
    return dealt.mapInArrow(assemble, schema)
