"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions, each distinct pre-token of the
corpus is encoded once by the merge ranks, its ids go back to the blocks that have it
and are put together by position (``pretokens``).  Decoding joins ids with the table of
token bytes, which the vocabulary bounds (some 50,000 short rows): every task holds it
and looks ids up in whole blocks.

Defined results: a null text counts as empty and has no ids; bytes survive the round
trip exactly; special tokens are not known, so their strings are ordinary text; an id
that is not in the table raises an error; repeated rows and null identifiers are
results of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from diffloom.llm.pretokens import Layout, per_block, per_word, word_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class TokenBytes:
    """Token-byte table as two arrays, for lookups of many ids at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        if (lengths == 0).any():
            raise ValueError("an id is not in the token-byte table")
        ends = np.cumsum(lengths)
        first = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.data[first + np.arange(len(first))].tobytes()


def _coded(docs, id_col, text_col, ranks_path, pattern, block_chars, finish, schema) -> DataFrame:
    def encoder():
        code = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}
        )
        return lambda words: [np.array(code._encode_single_piece(w), np.uint32).tobytes() for w in words]

    words = word_rows(docs, id_col, text_col, pattern, block_chars)
    return per_block(per_word(words, encoder), finish, schema)


def document_ids(layout: Layout, results: list[bytes]) -> Iterator[tuple[object, np.ndarray]]:
    """Identifier and token ids of every document of a block."""
    lengths = np.array([len(r) // 4 for r in results], np.int64)
    starts = np.cumsum(lengths) - lengths
    tokens = np.frombuffer(b"".join(results), np.uint32)
    for doc_id, (begin, end) in zip(layout.ids, layout.bounds):
        words = layout.places[begin:end]
        own = lengths[words]
        ends = np.cumsum(own)
        first = np.repeat(starts[words] - (ends - own), own)
        yield doc_id, tokens[first + np.arange(len(first))]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS,
    pattern: str = public_tokenizers.PATTERN, block_chars: int = 28 << 20,
) -> DataFrame:
    """One row per document: id, ids array<int>."""

    def finish(layout: Layout, results: list[bytes]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in document_ids(layout, results):
            yield pa.record_batch(
                [pa.array([doc_id], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))],
                [id_col, "ids"],
            )

    return _coded(
        docs, id_col, text_col, ranks_path, pattern, block_chars, finish,
        f"`{id_col}` long, ids array<int>",
    )


def decode(coded: DataFrame, id_col: str = "doc_id", ranks_path: str = RANKS) -> DataFrame:
    """One row per row of (id, ids): id, content binary."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(read_ranks(ranks_path))
        for batch in batches:
            contents = [
                table.decode(np.array(ids.as_py() or [], np.int64)) for ids in batch.column(1)
            ]
            yield pa.record_batch([batch.column(0), pa.array(contents, pa.binary())], [id_col, "content"])

    return coded.select(id_col, "ids").mapInArrow(look_up, f"`{id_col}` long, content binary")


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS,
    pattern: str = public_tokenizers.PATTERN, block_chars: int = 28 << 20,
) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes like ``encode`` and ``decode`` and keeps digests only.
    """

    def finish(layout: Layout, results: list[bytes]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(read_ranks(ranks_path))
        rows = [
            (
                doc_id,
                len(ids),
                hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(table.decode(ids)).hexdigest(),
            )
            for doc_id, ids in document_ids(layout, results)
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch(
            [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)],
            [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _coded(
        docs, id_col, text_col, ranks_path, pattern, block_chars, finish,
        f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
