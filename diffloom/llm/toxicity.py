"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine.

All words of a text are its terms, and document frequencies come from all documents.
The examples are a bounded random sample of the distinct labelled texts (``max_examples``,
the documented bound of this classifier); copies of a text are one example that weighs as
often as it is labelled.  Only terms of examples can add to a dot product, so these form an
inverted index, and the nearest examples are found while a text is read: their order does
not depend on the text's own norm.  The norm needs the frequency of every term.  Frequent
terms (``head``) are looked up on the way, all others are joined with the table of
frequencies, so cosines are exact whatever the size of the vocabulary.  The ``k`` nearest
examples vote with the inverse of their distance; the nearest ones are the evidence.

A second vote gives every term of the examples, besides its TF-IDF weight, the contrast of
its classes: the logarithm of how many times as often toxic training texts have it as others
do, less ``confidence`` standard errors (1.645: the one-sided bound of 95 per cent), and zero
where that is negative.  No count, list of terms or size decides which terms take part.  These
vectors are sparse, and an index in blocks holds the largest weight of every term per block:
the bound of a block for a text is the sum of its terms' block maxima, and blocks are scored
exactly in the order of their bounds until no bound reaches the k-th best cosine.

The mean of both votes is the vote of a text.  It is calibrated on all training rows (a text
does not vote on itself) by monotone rates in bins; a fiftieth of the score is the vote
itself, so that texts of bins with one rate keep their order.

Defined results: a text without any term, null and empty ones included, has no neighbours
and counts in the first vote as one whose nearest examples are toxic at the overall rate; a
text whose terms have no contrast has the second vote 0; among neighbours
with equal cosine the one with the lower place in the index counts; repeated rows are scored
each on their own; an id that several label rows have counts as toxic if one says so; null
labels and null ids give no training row; with no toxic or no other training rows every
score is the overall rate (0 without any row) and there is no evidence; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.bitmap import KeyBitmap
from diffloom.storage import stored

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_KEEP = set(string.ascii_lowercase.encode() + string.digits.encode())
#: Lower case; ASCII bytes other than letters and digits become spaces.
TERMS = bytes(b if b >= 128 or b in _KEEP else 32 for b in _LOWER)
MARKS = tuple(m.encode() for m in "¿¡«»“”„‘’…–—")


def terms_of(text: str | None) -> list[bytes]:
    data = (text or "").encode().translate(TERMS)
    if not data.isascii():
        for mark in MARKS:
            data = data.replace(mark, b" ")
    return data.split()


def term_statistics(labelled: DataFrame) -> DataFrame:
    """term, toxic, other: labelled texts of each kind that have the term; '' counts all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(terms, pa.binary())]
            columns += [pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0])]
            counts[0].clear(), counts[1].clear()
            return pa.record_batch(columns, ["term", "toxic", "other"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                own = set(terms_of(text.as_py()))
                own.add(b"")
                counts[label.as_py()].update(own)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
        yield flush()

    rows = labelled.select("text", "label")
    partial = rows.mapInArrow(count, "term binary, toxic long, other long")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def contrasts(toxic: np.ndarray, other: np.ndarray, sizes: tuple[int, int], confidence: float) -> np.ndarray:
    """Lower bounds of the log ratio of a term's rates in toxic and other texts, at least 0."""
    a, b = toxic + 0.5, other + 0.5
    ratio = np.log(a / (sizes[0] + 1)) - np.log(b / (sizes[1] + 1))
    error = np.sqrt(1 / a - 1 / (sizes[0] + 1) + 1 / b - 1 / (sizes[1] + 1))
    return np.maximum(0.0, ratio - confidence * error)


def text_hash(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63)


def text_hashes(docs: DataFrame) -> DataFrame:
    """id and mix (hash of the text) of ``docs(id, text)``."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixes = pa.array([text_hash(text.as_py()) for text in batch.column(1)], pa.int64())
            yield pa.record_batch([batch.column(0), mixes], ["id", "mix"])

    return docs.select("id", "text").mapInArrow(hashes, "id long, mix long")


class BlockMaxIndex:
    """Inverted index over examples in blocks, with each term's largest weight by block."""

    def __init__(self, examples: list, idf: np.ndarray, block: int = 64) -> None:
        self.idf = idf
        weighed = [(self.weights(e.terms, e.counts), e) for e in examples]
        # Examples with the same heaviest term share blocks, which sharpens the bounds.
        weighed.sort(key=lambda p: (p[1].terms[int(p[0].argmax())], p[1].mix))
        self.labels = np.array([e.label for _, e in weighed], np.float64)
        self.copies = np.array([getattr(e, "copies", 1) for _, e in weighed], np.float64)
        self.mixes = np.array([e.mix for _, e in weighed], np.int64)
        self.place_of = {mix: i for i, mix in enumerate(self.mixes.tolist())}
        self.blocks = max(1, -(-len(weighed) // block))
        places = np.repeat(np.arange(len(weighed)), np.array([len(w) for w, _ in weighed], np.int64))
        numbers = np.array([t for _, e in weighed for t in e.terms], np.int64)
        values = np.concatenate([np.zeros(0), *(w for w, _ in weighed)])
        order = np.lexsort((places, numbers))
        self.places, self.values = places[order], values[order]
        # Postings of a term in a block stand together and form a cell; only such cells are held.
        cells, first = np.unique(numbers[order] * self.blocks + self.places // block, return_index=True)
        self.first = np.append(first, len(values))
        self.block_of = cells % self.blocks
        self.bounds = np.maximum.reduceat(self.values, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cells // self.blocks, np.arange(len(idf) + 1))

    def weights(self, terms, counts) -> np.ndarray:
        raw = (1.0 + np.log(np.array(counts, np.float64))) * self.idf[np.array(terms, np.int64)]
        return raw / np.linalg.norm(raw)

    def nearest(self, terms, counts, k: int, without: int | None = None):
        """Places and cosines of the k nearest examples with a positive cosine, in order;
        the example whose text has the hash ``without`` is left out."""
        terms, query = np.array(terms, np.int64), self.weights(terms, counts)
        own = self.place_of.get(without) if without is not None else None
        cells, lengths = spans(self.cells, terms)
        query = np.repeat(query, lengths)
        blocks = self.block_of[cells]
        bounds = np.bincount(blocks, query * self.bounds[cells], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(self.blocks, np.int64)
        rank[order] = np.arange(self.blocks)
        ranks = rank[blocks]
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        done, end, step = 0, np.count_nonzero(bounds), 8
        while done < end:
            now = min(end, done + step)
            part = np.flatnonzero((ranks >= done) & (ranks < now))
            at, lengths = spans(self.first, cells[part])
            sums = np.bincount(
                self.places[at], self.values[at] * np.repeat(query[part], lengths), len(self.labels)
            )
            if own is not None:
                sums[own] = 0
            hit = np.flatnonzero(sums)
            places, cosines = np.concatenate((places, hit)), np.concatenate((cosines, sums[hit]))
            done, step = now, step * 4
            if len(cosines) >= k:
                worst = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                end = done + np.count_nonzero(bounds[order[done:end]] >= worst - 1e-12)
                # What is below the k-th best is out for good; the margin is that of the rounding below.
                stays = cosines >= min(worst, 1.0) - 4e-12
                places, cosines = places[stays], cosines[stays]
        cosines = np.minimum(cosines, 1.0)
        best = np.lexsort((places, -np.round(cosines, 12)))[:k]
        return places[best], cosines[best]


def spans(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from ``starts[w]`` to before ``starts[w + 1]`` for each w, and their numbers."""
    begin = starts[which]
    lengths = starts[which + 1] - begin
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - ends + lengths, lengths), lengths


def voice(labels: np.ndarray, copies: np.ndarray, cosines: np.ndarray) -> float | None:
    """Vote of the examples with these labels, copies and cosines, by the inverse of distance."""
    if not len(cosines):
        return None
    closeness = copies / (1.02 - cosines)
    return float((closeness * labels).sum() / closeness.sum())


def term_frequencies(docs: DataFrame) -> DataFrame:
    """term, n: texts that have the term; '' counts all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.record_batch(columns, ["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(set(terms_of(text.as_py())))
            counts[b""] += batch.num_rows
            if len(counts) > 500_000:
                yield flush()
        yield flush()

    partial = docs.select("text").mapInArrow(count, "term binary, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n"))


def distinct_examples(labelled: DataFrame, limit: int) -> DataFrame:
    """Random ``limit`` of the texts of ``labelled(id, mix, label, ...)``, one row for all copies."""
    others = [F.first(c).alias(c) for c in labelled.columns if c not in ("id", "mix", "label")]
    texts = labelled.groupBy("mix").agg(
        F.min("id").alias("id"), F.avg("label").alias("label"), F.count("*").alias("copies"), *others
    )
    return texts.orderBy("mix").limit(limit)


def example_terms(docs: DataFrame, sample: list) -> pa.Table:
    """mix, terms, counts: terms of the sampled texts with their counts."""
    wanted = {row.mix for row in sample}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for scalar in batch.column(0):
                text = scalar.as_py()
                if (mix := text_hash(text)) in wanted:
                    own = Counter(terms_of(text))
                    rows.append((mix, list(own), list(own.values())))
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["mix", "terms", "counts"])

    ids = docs.sparkSession.createDataFrame([(row.id,) for row in sample], "id long").distinct()
    texts = docs.join(F.broadcast(ids), "id", "left_semi").select("text")
    found = texts.mapInArrow(read, "mix long, terms array<binary>, counts array<int>")
    return found.where(F.size("terms") > 0).dropDuplicates(["mix"]).toArrow().combine_chunks()


class Example(NamedTuple):
    """Example of an index in blocks: numbers of its terms and their counts."""

    mix: int
    label: float
    copies: float
    terms: np.ndarray
    counts: np.ndarray


class ExampleIndex:
    """All terms of the examples: frequent ones as a dense matrix, others as postings.

    ``texts`` has the terms of examples, ``own`` and ``head`` the frequencies of these terms
    and of frequent ones among ``n`` texts.
    """

    def __init__(self, sample: list, texts: pa.Table, head: pa.Table, own: pa.Table, n: int):
        of_mix = {e.mix: e for e in sample}
        self.mixes = {mix: i for i, mix in enumerate(sorted(texts["mix"].to_pylist()))}
        held = [of_mix[mix] for mix in self.mixes]
        self.ids = [e.id for e in held]
        self.labels = np.array([e.label for e in held], np.float64)
        self.copies = np.array([e.copies for e in held], np.float64)
        self.number: dict[bytes, int] = {}
        frequency = []
        for table in (own, head):
            for term, f in zip(table["term"], table["n"]):
                if (word := term.as_py()) not in self.number:
                    self.number[word] = len(self.number)
                    frequency.append(f.as_py())
            if table is own:
                self.of_examples = len(self.number)
        self.idf = np.log((1.0 + n) / (1.0 + np.array(frequency, np.float64))) + 1.0
        lists = texts["terms"].combine_chunks()
        coded = pc.dictionary_encode(lists.flatten())
        codes = np.array([self.number[t.as_py()] for t in coded.dictionary], np.int64)
        number = codes[coded.indices.to_numpy()]
        rows = np.array([self.mixes[mix] for mix in texts["mix"].to_pylist()], np.int32)
        place = np.repeat(rows, pc.list_value_length(lists).to_numpy())
        counts = texts["counts"].combine_chunks().flatten().to_numpy().astype(np.float64)
        value = (1.0 + np.log(counts)) * self.idf[number]
        value /= np.sqrt(np.bincount(place, value * value, len(held)))[place]
        self.bags = (place, number, counts)
        lengths = np.bincount(number, minlength=self.of_examples)
        often = np.flatnonzero(lengths * 8 > len(held))
        # The matrix is bounded; the least frequent of these terms have postings like others.
        often = often[np.argsort(-lengths[often], kind="stable")][:1024]
        self.row = np.full(self.of_examples, -1, np.int64)
        self.row[often] = np.arange(len(often))
        dense = self.row[number] >= 0
        self.matrix = np.zeros((len(often), len(held)))
        self.matrix[self.row[number[dense]], place[dense]] = value[dense]
        place, number, value = place[~dense], number[~dense], value[~dense]
        order = np.argsort(number, kind="stable")
        self.places, self.values = place[order], value[order]
        self.lengths = np.bincount(number, minlength=self.of_examples)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def contrasted(self, classes: pa.Table, sizes: tuple[int, int], confidence: float) -> BlockMaxIndex:
        """Index of the same examples with the contrast of each term in its weight.

        ``classes`` has the number of texts of each kind for the terms; ``slot`` then leads from
        a term's number to that in the index, or to -1 where the term has no contrast.
        """
        toxic, other = np.zeros(self.of_examples), np.zeros(self.of_examples)
        numbers = [self.number[term.as_py()] for term in classes["term"]]
        toxic[numbers], other[numbers] = classes["toxic"].to_numpy(), classes["other"].to_numpy()
        contrast = contrasts(toxic, other, sizes, confidence)
        known = np.flatnonzero(contrast > 0)
        self.slot = np.full(len(self.number), -1, np.int64)
        self.slot[known] = np.arange(len(known))
        place, number, counts = self.bags
        slots = self.slot[number]
        order = np.lexsort((slots, place))
        order = order[slots[order] >= 0]
        ends = np.cumsum(np.bincount(place[order], minlength=len(self.ids)))[:-1]
        bags = zip(np.split(slots[order], ends), np.split(counts[order], ends))
        examples = [
            Example(mix, label, copies, *bag)
            for mix, label, copies, bag in zip(self.mixes, self.labels, self.copies, bags) if len(bag[0])
        ]
        del self.bags
        return BlockMaxIndex(examples, self.idf[known] * contrast[known])

    def weighed(self, text: str | None):
        """Numbers, counts and weights of known terms, and (term, count) of all others."""
        bag = Counter(terms_of(text))
        numbers = np.fromiter(map(self.number.get, bag, repeat(-1)), np.int64, len(bag))
        counts = np.fromiter(bag.values(), np.float64, len(bag))
        known = numbers >= 0
        rest = [(t, n) for (t, n), held in zip(bag.items(), known.tolist()) if not held]
        numbers, counts = numbers[known], counts[known]
        return numbers, counts, (1.0 + np.log(counts)) * self.idf[numbers], rest

    def dots(self, queries: list) -> np.ndarray:
        """Dot products of weights with all examples, a row for each of (numbers, weights)."""
        dense = np.zeros((len(queries), len(self.matrix)))
        sums = np.zeros((len(queries), len(self.ids)))
        for q, (numbers, weights) in enumerate(queries):
            own = numbers < self.of_examples
            numbers, weights = numbers[own], weights[own]
            row = self.row[numbers]
            dense[q, row[row >= 0]] = weights[row >= 0]
            numbers, weights = numbers[row < 0], weights[row < 0]
            lengths = self.lengths[numbers]
            ends = np.cumsum(lengths)
            if len(ends) and ends[-1]:
                at = np.arange(ends[-1]) + np.repeat(self.starts[numbers] - ends + lengths, lengths)
                sums[q] = np.bincount(
                    self.places[at], self.values[at] * np.repeat(weights, lengths), len(self.ids)
                )
        return sums + dense @ self.matrix

    def nearest(self, dots: np.ndarray, k: int) -> np.ndarray:
        """Places of the k largest positive dot products, in order."""
        if len(dots) > k:
            least = np.partition(dots, len(dots) - k)[len(dots) - k]
            places = np.flatnonzero((dots > 0) & (dots >= least * (1 - 1e-12)))
        else:
            places = np.flatnonzero(dots > 0)
        top = dots[places].max(initial=1e-300)
        return places[np.lexsort((places, -np.round(dots[places] / top, 12)))[:k]]


def lists_of(lengths: list[int], **columns: pa.Array) -> pa.ListArray:
    """Lists of structs from flat columns; the lists have these lengths."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), list(columns)))


VOTES = (
    "row long, id long, vote double, own_vote double, place int, square double, "
    "near array<struct<place: int, dot: double>>, rest array<struct<term: binary, count: int>>"
)


def votes(docs: DataFrame, whole: ExampleIndex, index: BlockMaxIndex, k: int) -> DataFrame:
    """For each row the votes by terms with contrast, with and without the text itself, and its
    k + 1 nearest examples by all terms: dot products, the square of the norm as far as its terms
    are known, and the other terms.  ``place`` is that of the text itself, if it is an example."""
    held = docs.sparkSession.sparkContext.broadcast((whole, index))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, index = held.value
        seen: dict = {}
        row = TaskContext.get().partitionId() << 33

        def contrast_votes(mix: int, numbers: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
            slots = whole.slot[numbers]
            if not (known := slots >= 0).any():
                return 0.0, 0.0
            places, cosines = index.nearest(slots[known], counts[known], k + 1)
            others = places != index.place_of.get(mix, -1)
            of = index.labels[places], index.copies[places], cosines
            return voice(*(x[:k] for x in of)) or 0.0, voice(*(x[others][:k] for x in of)) or 0.0

        def results(texts: list[tuple[int, str | None]]) -> None:
            queries = [whole.weighed(text) for _, text in texts]
            all_dots = whole.dots([(numbers, weights) for numbers, _, weights, _ in queries])
            for (mix, _), (numbers, counts, weights, rest), dots in zip(texts, queries, all_dots):
                near = whole.nearest(dots, k + 1)
                seen[mix] = (
                    *contrast_votes(mix, numbers, counts), whole.mixes.get(mix), float(weights @ weights),
                    near, dots[near], rest,
                )

        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                texts = part.column(1).to_pylist()
                mixes = [text_hash(text) for text in texts]
                if len(seen) > 2000:
                    seen.clear()
                new = {m: t for m, t in zip(mixes, texts) if m not in seen}
                results(list(new.items()))
                *rows, near, dots, rest = zip(*(seen[m] for m in mixes))
                kinds = (pa.float64(), pa.float64(), pa.int32(), pa.float64())
                others = [of for own in rest for of in own]
                yield pa.record_batch(
                    [
                        pa.array(range(row, row + len(mixes)), pa.int64()), part.column(0),
                        *(pa.array(v, t) for v, t in zip(rows, kinds)),
                        lists_of(
                            [len(p) for p in near], place=pa.array(np.concatenate(near), pa.int32()),
                            dot=pa.array(np.concatenate(dots), pa.float64()),
                        ),
                        lists_of(
                            [len(own) for own in rest], term=pa.array([t for t, _ in others], pa.binary()),
                            count=pa.array([n for _, n in others], pa.int32()),
                        ),
                    ],
                    ["row", "id", "vote", "own_vote", "place", "square", "near", "rest"],
                )
                row += len(mixes)

    return docs.mapInArrow(score, VOTES)


def neighbours(voted: DataFrame, frequencies: DataFrame, whole: ExampleIndex, n: int, k: int, shown: int):
    """id, vote, own_vote, full, own_full, evidence: cosines with the norms over all terms."""
    idf = F.log((1.0 + F.lit(n)) / (1.0 + F.col("n"))) + 1.0
    rest = (
        voted.select("row", F.explode("rest").alias("of")).select("row", "of.term", "of.count")
        .join(frequencies, "term")
        .groupBy("row").agg(F.sum(F.pow((1.0 + F.log("count")) * idf, 2)).alias("more"))
    )
    session = voted.sparkSession
    places = [(i, float(label), float(c), int(own)) for i, (label, c, own) in enumerate(
        zip(whole.labels, whole.copies, whole.ids))]
    table = session.sparkContext.broadcast(places)
    norms = voted.drop("rest").join(rest, "row", "left").withColumn(
        "norm", F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, copies, ids = (list(c) for c in zip(*table.value)) if table.value else ([],) * 4
        labels, copies = np.array(labels), np.array(copies)

        def voted(at: np.ndarray, cosines: np.ndarray) -> float | None:
            return voice(labels[at], copies[at], cosines)

        for batch in batches:
            own, near, norm = (batch.column(c) for c in ("place", "near", "norm"))
            full, own_full, lengths, examples, close = [], [], [], [], []
            flat = pc.list_flatten(near)
            places, dots = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("place", "dot"))
            ends = np.cumsum(pc.list_value_length(near).to_numpy(zero_copy_only=False)).tolist()
            for place, begin, end, length in zip(own.to_pylist(), [0, *ends], ends, norm.to_pylist()):
                at = places[begin:end]
                cosines = np.minimum(dots[begin:end] / (length or 1.0), 1.0)
                full.append(voted(at[:k], cosines[:k]))
                if place is None:
                    own_full.append(full[-1])
                else:
                    others = at != place
                    own_full.append(voted(at[others][:k], cosines[others][:k]))
                lengths.append(len(at[:shown]))
                examples += at[:shown].tolist()
                close += cosines[:shown].tolist()
            evidence = lists_of(
                lengths, example=pa.array([ids[p] for p in examples], pa.int64()), cosine=pa.array(close, pa.float64())
            )
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("id", "vote", "own_vote")),
                    pa.array(full, pa.float64()), pa.array(own_full, pa.float64()), evidence,
                ],
                ["id", "vote", "own_vote", "full", "own_full", "evidence"],
            )

    return norms.select("id", "vote", "own_vote", "place", "near", "norm").mapInArrow(
        finish,
        "id long, vote double, own_vote double, full double, own_full double, "
        "evidence array<struct<example: long, cosine: double>>",
    )


def monotone(rates: list[float], sizes: list[float]) -> list[float]:
    """Closest non-decreasing rates (pooled adjacent violators)."""
    pools: list[list[float]] = []
    for rate, size in zip(rates, sizes):
        pools.append([rate, size, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            r, s, n = pools.pop()
            q = pools[-1]
            q[0], q[1], q[2] = (q[0] * q[1] + r * s) / (q[1] + s), q[1] + s, q[2] + n
    return [rate for rate, _, n in pools for _ in range(n)]


def calibrated(vote: Column, rates: list[float]) -> Column:
    """Piecewise linear between the centres of the bins."""
    bins = len(rates)
    at = vote * bins - 0.5
    score = F.when(at <= 0, F.lit(rates[0]))
    for i in range(bins - 1):
        score = score.when(at <= i + 1, F.lit(rates[i]) + (at - i) * (rates[i + 1] - rates[i]))
    return score.otherwise(F.lit(rates[-1]))


def toxicity(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", k: int = 25, max_examples: int = 4096, confidence: float = 1.645,
    bins: int = 20, shown: int = 3, head: int = 100_000,
) -> DataFrame:
    """One row per document: id, score, evidence; ``training`` has (id_col, label_col)."""
    labels = stored(
        training.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).cast("int").alias("label"))
    )
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Labels grow with the documents, so neither side is broadcast, at any size.
    maybe = own.where(KeyBitmap(labels, "id").may_have("id"))
    statistics = stored(term_statistics(maybe.join(labels.hint("merge"), "id")))
    total = statistics.where(F.length("term") == 0).collect()
    sizes = (int(total[0].toxic), int(total[0].other)) if total else (0, 0)
    rate = sizes[0] / sum(sizes) if sum(sizes) else 0.0
    if not all(sizes):
        none = F.array().cast("array<struct<example: bigint, cosine: double>>")
        return own.select(F.col("id").alias(id_col), F.lit(rate).alias("score"), none.alias("evidence"))

    frequencies = stored(term_frequencies(own))
    n = frequencies.where(F.length("term") == 0).collect()[0].n
    words = frequencies.where(F.length("term") > 0)
    sample = distinct_examples(text_hashes(maybe).join(labels.hint("merge"), "id"), max_examples).collect()
    texts = example_terms(own, sample)
    of_examples = pa.table({"term": pc.unique(pc.list_flatten(texts["terms"])).cast(pa.binary())})

    def of_these(table: DataFrame) -> pa.Table:
        few = docs.sparkSession.createDataFrame(of_examples)
        return table.join(F.broadcast(few), "term").toArrow()

    whole = ExampleIndex(
        sample, texts, words.orderBy(F.desc("n"), "term").limit(head).toArrow(), of_these(words), n,
    )
    index = whole.contrasted(of_these(statistics), sizes, confidence)
    found = stored(votes(own, whole, index, k))
    voted = stored(neighbours(found, words, whole, n, k, shown))

    def mean(vote: str, full: str) -> Column:
        return (F.col(vote) + F.coalesce(F.col(full), F.lit(rate))) / 2

    in_bin = F.least(F.floor(mean("own_vote", "own_full") * bins), F.lit(bins - 1))
    rows = voted.join(labels, "id").groupBy(in_bin.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("label").alias("toxic")
    )
    cells = {row.bin: (row.n, row.toxic) for row in rows.collect()}
    centres = [(b + 0.5) / bins for b in range(bins)]
    held = [cells.get(b, (0, 0)) for b in range(bins)]
    rates = monotone(
        [(hits + 2.0 * centre) / (size + 2.0) for (size, hits), centre in zip(held, centres)],
        [size + 2.0 for size, _ in held],
    )
    vote = mean("vote", "full")
    score = 0.98 * calibrated(vote, rates) + 0.02 * vote
    return voted.select(F.col("id").alias(id_col), score.alias("score"), "evidence")
