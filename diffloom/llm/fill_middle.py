"""Fill-in-middle transformation of documents, cut between units such as lines.

A text is cut by one match: the pattern ``(unit)*`` has to match the whole text, and the
regex library keeps every repetition of the group, so ``match.ends(1)`` are the ends of all
units.  Its length is n, and both cuts are entries of it.  The numbers that choose the
cuts and the form come from the SHA-256 of seed and identifier, so a row is transformed
alike wherever and whenever it is worked on.  The work is a projection of the row; Arrow
batches carry texts to Python and back.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle`` and
``plain`` is the text itself.

Defined results: a null text counts as empty; an empty text, a text that holds a marker and
a text that units do not cover as a whole are plain; the decimal form of a null identifier is
empty; repeated rows, and rows that share an identifier and have as many units, are cut
alike; other columns are ignored; an empty table gives an empty result.  Texts of any length
are cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*\n|[^\n]+"
CUT = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def within(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


def draws(seed: int, identifier: int | None) -> list[int]:
    """Four 32-bit numbers of an identifier."""
    name = "" if identifier is None else str(identifier)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


class Cutter:
    """Cuts single texts; one for each task."""

    def __init__(self, unit: str, seed: int, rate: int, spm_rate: int, markers: Markers) -> None:
        self.units = regex.compile(f"({unit})*")
        self.seed, self.rate, self.spm_rate, self.markers = seed, rate, spm_rate, markers

    def cut(self, identifier: int | None, text: str) -> tuple:
        """n, form, prefix and middle length, output."""
        match = self.units.fullmatch(text)
        ends = match.ends(1) if match else []
        first, second, chance, order = draws(self.seed, identifier)
        n = len(ends)
        if not n or self.markers.within(text) or chance % 100 >= self.rate:
            return n, "plain", None, None, text
        places = sorted((first % (n + 1), second % (n + 1)))
        start, stop = (ends[i - 1] if i else 0 for i in places)
        m = self.markers
        before, after = m.prefix + text[:start], m.suffix + text[stop:]
        form = "spm" if order % 100 < self.spm_rate else "psm"
        parts = (after, before) if form == "spm" else (before, after)
        return n, form, start, stop - start, "".join((*parts, m.middle, text[start:stop]))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7,
    rate: int = 100, spm_rate: int = 50, markers: Markers = Markers(),
) -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output.

    ``rate`` of 100 documents are transformed, and ``spm_rate`` of 100 of these put the suffix first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(unit, seed, rate, spm_rate, markers)
        for batch in batches:
            # Small slices: results of a batch are not held all at once.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [
                    cutter.cut(i.as_py(), t.as_py() or "") for i, t in zip(part.column(0), part.column(1))
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch(
                    [part.column(0), *columns],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, CUT).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """Text that an output was made of."""

    def between(start: Column, stop: Column) -> Column:
        return F.substring(output, start, stop - start)

    def from_(start: Column) -> Column:
        return F.substring(output, start, F.length(output))

    p, s, m = (F.instr(output, marker) for marker in (markers.prefix, markers.suffix, markers.middle))
    after = {"p": p + len(markers.prefix), "s": s + len(markers.suffix), "m": m + len(markers.middle)}
    psm = F.concat(between(after["p"], s), from_(after["m"]), between(after["s"], m))
    spm = F.concat(between(after["p"], m), from_(after["m"]), between(after["s"], p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
