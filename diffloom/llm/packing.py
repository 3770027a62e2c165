"""Documents packed into windows by non-negative least squares over their lengths.

Full windows of a document are sequences of their own; its tail, shorter than a window,
is packed with other tails.  Only the histogram of tail lengths (at most ``window - 1``
rows) is needed to plan: shallow combinations of lengths that fill a window exactly are
columns of a matrix, and the non-negative repeat counts that come closest to the
histogram are solved for and rounded down within it.  The tails left over are packed
greedily end to end and cut where a window is full, so padding is in the last sequence
only, whatever the lengths are.

The plan maps (length, rank among tails of this length) to a sequence and an offset by
intervals of ranks.  Ranks come from a range-partitioned sort of small rows, so a length
that a third of all documents share is split between tasks and no task sees a whole
length, nor the driver anything but the histogram.

Defined results: a null text counts as empty, which is one token, the terminator; ties
in length are ordered by the document's identifier; repeated rows and null identifiers
are documents of their own; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.storage import numbered, stored

MODEL = public_tokenizers.path("byte_bpe_50k.json")
#: Outside of these characters, and for texts that may hold special tokens, the two
#: libraries' notions of letters and white space are not relied on to be the same.
UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ]|<\|")


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level models write for bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them, without special tokens added.

    A byte-level model whose ids follow its merges is the same as a table of ranks,
    which is several times faster; unusual texts go to the tokenizers library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    byte_level = (
        before.get("type") == "ByteLevel" and before.get("use_regex", True)
        and not before.get("add_prefix_space") and spec["normalizer"] is None
        and model["type"] == "BPE" and not model.get("ignore_merges")
    )
    if not byte_level:
        return slow
    letters, special = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab[t] for t in merged] != list(range(256, 256 + len(merged))):
        return slow
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> np.ndarray:
        if UNUSUAL.search(text):
            return slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


CODED = "id long, tokens long, crcs array<long>, tail_length long, tail binary, tail_crc long"


def coded_documents(
    docs: DataFrame, id_col: str, text_col: str, window: int, terminator: int, model: str
) -> DataFrame:
    """Checksums of full windows, and the tail's length, ids and checksum, per document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(model)
        for batch in batches:
            columns = [[] for _ in range(5)]
            for text in batch.column(1):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(terminator))
                full = len(ids) // window * window
                tail = ids[full:]
                narrow = tail.astype("<u2") if len(tail) and tail.max() < 1 << 16 else tail.astype("<u4")
                row = (
                    len(ids), [crc(ids[i : i + window]) for i in range(0, full, window)],
                    len(tail), narrow.tobytes(), crc(tail),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64())
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["id", "tokens", "crcs", "tail_length", "tail", "tail_crc"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, CODED)


@dataclass
class Plan:
    """Intervals of ranks by length, sorted by (length, first rank); the rest is packed end to end."""

    window: int
    lengths: np.ndarray  # of intervals
    firsts: np.ndarray
    sequences: np.ndarray  # of the interval's first rank; one more for each further rank
    offsets: np.ndarray
    used: np.ndarray  # by length: ranks that the intervals hold
    starts: np.ndarray  # by length: where its left tails begin, end to end
    packed: int  # sequences of the intervals
    total: int  # with those end to end

    def place(self, length: np.ndarray, rank: np.ndarray):
        """sequence, offset of tails; those end to end may pass the end of their window."""
        left = rank >= self.used[length]
        at = self.starts[length] + (rank - self.used[length]) * length
        # Intervals are found by one sorted key, as lengths are bounded and ranks are not.
        begin = np.searchsorted(self.lengths, length)
        found = begin.copy()
        for value in np.unique(length[~left]):
            rows = np.flatnonzero((length == value) & ~left)
            lo, hi = np.searchsorted(self.lengths, [value, value + 1])
            found[rows] = lo + np.searchsorted(self.firsts[lo:hi], rank[rows], "right") - 1
        found = np.minimum(found, max(0, len(self.lengths) - 1))
        if len(self.lengths):
            sequence = self.sequences[found] + rank - self.firsts[found]
            offset = self.offsets[found]
        else:
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        return (
            np.where(left, self.packed + at // self.window, sequence),
            np.where(left, at % self.window, offset),
        )


def combinations(window: int, present: np.ndarray, depth: int = 8, grid: int = 16):
    """Columns of up to three lengths (k x 3) with repeats (k x 3) that fill a window.

    ``a`` up to ``depth`` times with one ``b``, and triples whose first length is on a grid.
    """
    on_hand = np.flatnonzero(present)
    lengths, repeats = [], []
    for times in range(1, depth + 1):
        rest = window - times * on_hand
        good = (rest > 0) & (rest != on_hand)
        good[good] &= present[rest[good]] > 0
        if times == 1:
            good &= on_hand < rest
        a, b = on_hand[good], rest[good]
        lengths.append(np.stack([a, b, np.zeros_like(a)], 1))
        repeats.append(np.stack([np.full_like(a, times), np.ones_like(a), np.zeros_like(a)], 1))
    even = on_hand[(window % np.maximum(on_hand, 1) == 0) & (on_hand > 0)]
    lengths.append(np.stack([even, np.zeros_like(even), np.zeros_like(even)], 1))
    repeats.append(np.stack([window // np.maximum(even, 1), np.zeros_like(even), np.zeros_like(even)], 1))
    for a in on_hand[on_hand % grid == 0]:
        b = on_hand[(on_hand > a) & (on_hand < window - a - on_hand)]
        c = window - a - b
        good = present[c] > 0
        b, c = b[good], c[good]
        lengths.append(np.stack([np.full_like(b, a), b, c], 1))
        repeats.append(np.ones((len(b), 3), np.int64) )
    return np.concatenate(lengths), np.concatenate(repeats)


def least_squares(lengths, repeats, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that bring A x close to the histogram (multiplicative updates)."""
    size = len(histogram)

    def product(x):
        total = np.zeros(size)
        for i in range(3):
            total += np.bincount(lengths[:, i], repeats[:, i] * x, size)
        return total

    def transposed(y):
        return (y[lengths] * repeats).sum(axis=1)

    goal = transposed(histogram.astype(float))
    x = np.ones(len(lengths)) * histogram.sum() / max(1, repeats.sum())
    for _ in range(rounds):
        x *= goal / np.maximum(transposed(product(x)), 1e-12)
    return x


def plan(histogram: dict[int, int], window: int, depth: int = 8, grid: int = 16) -> Plan:
    """Plan for tails of the lengths 1 .. window - 1."""
    have = np.zeros(window, np.int64)
    for length, n in histogram.items():
        have[length] = n
    lengths, repeats = combinations(window, have, depth, grid)
    wanted = np.floor(least_squares(lengths, repeats, have) if len(lengths) else np.zeros(0))
    left, packed = have.copy(), 0
    rows: list[tuple[int, int, int, int]] = []
    for c in np.argsort(-wanted, kind="stable"):
        parts = [(int(a), int(k)) for a, k in zip(lengths[c], repeats[c]) if k]
        times = min([int(wanted[c]), *(int(left[a]) // k for a, k in parts)])
        if times <= 0:
            continue
        offset = 0
        for a, k in parts:
            for _ in range(k):
                rows.append((a, int(have[a] - left[a]), packed, offset))
                left[a] -= times
                offset += a
        packed += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    sizes = left * np.arange(window)
    # Long tails first, so that short ones are cut least.
    starts = np.zeros(window, np.int64)
    starts[::-1] = np.cumsum(sizes[::-1]) - sizes[::-1]
    total = packed + -(-int(sizes.sum()) // window)
    return Plan(window, *table.T, have - left, starts, packed, total)


PIECES = (
    "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "`offset` long, cut boolean"
)


def _pieces(placed: DataFrame, layout: Plan, documents: int) -> DataFrame:
    window = layout.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("tail_length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = layout.place(length, rank)
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("id", "tokens", "crcs", "tail", "tail_crc", "number")]
            for i, (doc_id, tokens, crcs, tail, tail_crc, number) in enumerate(zip(*columns)):
                for k, value in enumerate(crcs):
                    # Windows of document i have the numbers i, i + documents, ... after all others.
                    rows.append(
                        (doc_id, k * window, window, value, tokens, layout.total + number + k * documents, 0, False)
                    )
                n, start = int(length[i]), len(crcs) * window
                if not n:
                    continue
                at, where = int(offset[i]), int(sequence[i])
                first = min(n, window - at)
                if first == n:
                    rows.append((doc_id, start, n, tail_crc, tokens, where, at, False))
                    continue
                ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * n else "<u4")
                rows.append((doc_id, start, first, crc(ids[:first]), tokens, where, at, True))
                rows.append((doc_id, start + first, n - first, crc(ids[first:]), tokens, where + 1, 0, True))
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            values = list(zip(*rows)) or [[]] * 8
            yield pa.record_batch(
                [pa.array(v, k) for v, k in zip(values, kinds)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"],
            )

    return placed.mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
    terminator: int = 1, model: str = MODEL, depth: int = 8, grid: int = 16,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cut."""
    coded = stored(
        coded_documents(docs, id_col, text_col, window, terminator, model)
        .withColumn("row", F.monotonically_increasing_id())
    )
    counts = coded.groupBy("tail_length").count().collect()
    histogram = {r.tail_length: r["count"] for r in counts}
    before, begins = 0, {}
    for length in sorted(histogram):
        begins[length] = before
        before += histogram[length]
    layout = plan({k: v for k, v in histogram.items() if k}, window, depth, grid)
    places = numbered(coded.select("tail_length", "id", "row"), "tail_length", "id", "row")
    first = coded.sparkSession.createDataFrame(
        [(k, v) for k, v in begins.items()], "tail_length long, begin long"
    )
    ranks = places.join(F.broadcast(first), "tail_length").select(
        "row", "number", (F.col("number") - F.col("begin")).alias("rank")
    )
    placed = coded.join(ranks, "row")
    return _pieces(placed, layout, before).withColumnRenamed("id", id_col)
