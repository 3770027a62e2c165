import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer, models

from diffloom.llm.byte_bpe import RANKS, TokenBytes, decode, encode, read_ranks, round_trip
from diffloom.llm.packing import MODEL, coded_documents, combinations, encoder, pack, plan
from diffloom.llm.pretokens import packed, packed_bytes, unpacked, unpacked_bytes
from diffloom.llm.token_counts import SharedForward, unigram_counts, zipf_scores

TEXTS = [
    (1, "Hello, hello world's  end\n\n  x"), (2, None), (3, ""), (4, "naïve 数学 😀 \u0085  ß"), (5, "a" * 5000),
    (6, "Hello, hello world's  end\n\n  x"), (None, "it's <|endoftext|> 12345"), (8, "\x00\x1c\r\n\t"),
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={}
    )


def test_packing_of_arrays():
    for arrays in ([], [np.array([], np.uint32)], [np.arange(70_000), np.array([1 << 31])]):
        back = unpacked(packed(*map(np.asarray, arrays)))
        assert [a.tolist() for a in back] == [np.asarray(a).tolist() for a in arrays]
    items = [b"", b"ab", b"\n", b"x" * 70_000]
    assert unpacked_bytes(packed_bytes(items)) == items


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_round_trip_equals_the_library(docs, library, block):
    got = [tuple(r) for r in round_trip(docs(TEXTS * 2), block_chars=block).collect()]
    want = []
    for i, text in TEXTS * 2:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((
            i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        ))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_encode_and_decode(docs, library):
    coded = encode(docs(TEXTS))
    assert {r[0]: list(r[1]) for r in coded.collect()} == {
        i: library.encode_ordinary(t or "") for i, t in TEXTS
    }
    assert {r[0]: bytes(r[1]) for r in decode(coded).collect()} == {i: (t or "").encode() for i, t in TEXTS}


def test_unknown_id_is_an_error():
    with pytest.raises(ValueError):
        TokenBytes({b"a": 0, b"b": 2}).decode(np.array([0, 1]))


def test_empty_table(docs):
    for operator in (round_trip, encode, unigram_counts, pack):
        assert operator(docs([])).collect() == []


def unigram_library(scores):
    vocabulary = [("￿", -1e9)] + [(k.decode("latin1"), v) for k, v in scores.items()]
    return Tokenizer(models.Unigram(vocabulary, 0, False))


def test_unigram_counts_equal_the_library(docs):
    exact = unigram_library(zipf_scores(RANKS))
    got = {r[0]: r[2] for r in unigram_counts(docs(TEXTS)).collect()}
    for i, text in TEXTS:
        words = regex.findall(public_tokenizers.PATTERN, text or "")
        assert got[i] == sum(len(exact.encode(w.encode().decode("latin1")).ids) for w in words)


def test_prefixes_are_scored_once():
    scores = {b"a": -1.0, b"ab": -1.5, b"b": -1.0, b"c": -1.0}
    forward = SharedForward(scores, -10.0)
    assert [forward.count(w) for w in (b"ab", b"aba", b"abab", b"abc", b"x")] == [1, 2, 2, 2, 1]
    assert forward.steps == 2 + 1 + 1 + 1 + 1


def test_fast_ids_are_those_of_the_tokenizers_library():
    exact, own = Tokenizer.from_file(MODEL), encoder(MODEL)
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x4E2D, 0x1F600, 0x0660]]
    for _ in range(300):
        text = "".join(rng.choice(letters, 40))
        assert own(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert own("a<|endoftext|>b").tolist() == exact.encode("a<|endoftext|>b", add_special_tokens=False).ids


def check_pieces(rows, want, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc, key=str) == sorted(want, key=str)
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            import zlib

            piece = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece.tobytes()))
            at += r.length
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        used += at
    return len(by_sequence) * window - used


@pytest.mark.parametrize("window", [16, 64])
def test_packing(docs, words, window):
    rows = [(i, words(1 + i * 7 % 40)) for i in range(120)] + [(900, None), (901, ""), (902, "b" * 4000)]
    exact = Tokenizer.from_file(MODEL)
    want = {i: exact.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    padding = check_pieces(pack(docs(rows), window=window).collect(), want, window)
    assert padding < window


def test_packing_of_one_length_that_fills_no_window(docs):
    rows = [(i, "a b c d e f") for i in range(50)]
    want = {i: Tokenizer.from_file(MODEL).encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    assert check_pieces(pack(docs(rows), window=16).collect(), want, 16) < 16


def test_plan_fills_windows_and_uses_every_rank_once():
    histogram = {3: 40, 5: 17, 13: 30, 11: 20, 8: 9, 1: 3}
    layout = plan(histogram, 16)
    places = {}
    for length, n in histogram.items():
        rank = np.arange(n)
        sequence, offset = layout.place(np.full(n, length), rank)
        for s, o in zip(sequence.tolist(), offset.tolist()):
            for k in range(length):
                key = (s + (o + k) // 16, (o + k) % 16)
                assert key not in places
                places[key] = length
    assert len(places) == sum(k * n for k, n in histogram.items())
    assert layout.packed > 0.5 * layout.total
    lengths, repeats = combinations(16, np.bincount([3, 5, 13, 8], minlength=16))
    assert ((lengths * repeats).sum(axis=1) == 16).all()


def test_tails_of_wide_ids(docs):
    row = coded_documents(docs([(1, "x")]), "doc_id", "text", 8, 70_000, MODEL).collect()[0]
    assert np.frombuffer(row.tail, "<u4").tolist()[-1] == 70_000
