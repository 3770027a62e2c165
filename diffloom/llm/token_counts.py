"""Token counts under a unigram model, by dynamic programming shared along a trie.

A text is cut into pre-tokens.  A pre-token has the number of pieces of its best
segmentation: the forward score of a prefix is the largest, over its last piece, of the
score before that piece plus the score of the piece.  Forward scores depend on the
prefix only, so the distinct pre-tokens of the corpus are walked as a trie: in byte
order, keeping the scores along the current path, each shared prefix is scored once.
Counts of whole pre-tokens (terminals) go back to the blocks and are summed by document.

Pieces and scores come from a public vocabulary; nothing is trained.  A rank file
holds no probabilities, so its pieces get those of Zipf's law by rank.

Defined results: of segmentations with equal scores the one whose last piece is longest
counts; a byte that no piece covers is one piece of its own with the score ``unknown``;
a null text counts as empty and has 0 tokens; repeated rows and null identifiers are
results of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from diffloom.llm.byte_bpe import RANKS, read_ranks
from diffloom.llm.pretokens import Layout, per_block, per_word, word_rows


def zipf_scores(ranks_path: str) -> dict[bytes, float]:
    ranks = read_ranks(ranks_path)
    total = math.log(sum(1 / (rank + 1) for rank in ranks.values()))
    return {piece: -math.log(rank + 1) - total for piece, rank in ranks.items()}


class SharedForward:
    """Number of pieces of words that come in byte order."""

    def __init__(self, scores: dict[bytes, float], unknown: float) -> None:
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)
        self.word = b""
        self.best, self.pieces = [0.0], [0]
        self.steps = 0

    def count(self, word: bytes) -> int:
        shared = 0
        for a, b in zip(self.word, word):
            if a != b:
                break
            shared += 1
        best, pieces, score_of = self.best, self.pieces, self.scores.get
        del best[shared + 1 :], pieces[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, at = best[end - 1] + self.unknown, end - 1
            known = False
            for begin in range(max(0, end - self.longest), end):
                score = score_of(word[begin:end])
                if score is not None and (not known and begin == end - 1 or best[begin] + score > top):
                    top, at, known = best[begin] + score, begin, True
            best.append(top)
            pieces.append(pieces[at] + 1)
            self.steps += 1
        self.word = word
        return pieces[-1]


def unigram_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS,
    pattern: str = public_tokenizers.PATTERN, unknown: float = -30.0, block_chars: int = 28 << 20,
) -> DataFrame:
    """One row per document: id, n_pretokens, n_tokens."""

    def counter():
        forward = SharedForward(zipf_scores(ranks_path), unknown)
        return lambda words: [forward.count(word).to_bytes(4, "little") for word in words]

    def finish(layout: Layout, results: list[bytes]) -> Iterator[pa.RecordBatch]:
        of_word = np.frombuffer(b"".join(results), np.uint32).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(of_word[layout.places])])
        tokens = [int(total[end] - total[begin]) for begin, end in layout.bounds]
        yield pa.record_batch(
            [
                pa.array(layout.ids, pa.int64()),
                pa.array(layout.lengths, pa.int64()),
                pa.array(tokens, pa.int64()),
            ],
            [id_col, "n_pretokens", "n_tokens"],
        )

    words = word_rows(docs, id_col, text_col, pattern, block_chars)
    return per_block(
        per_word(words, counter), finish, f"`{id_col}` long, n_pretokens long, n_tokens long"
    )
