"""What a piece of a patch knows of its hunks, for the Python workers that get pieces in Arrow batches.

Counts and searches run over the text of a whole hunk; only the lines that a symbol rule may match are
looked at one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from struct import unpack

import pyarrow as pa

from diffloom.functions.dialect import BLANK, required_words
from diffloom.functions.rules import SYMBOL_EXTENSIONS, SYMBOL_PATTERNS
from diffloom.functions.text import CHANGED_MARK, OTHER_LINE_ENDS

_CUT_FILES = re.compile(r"\n(?=--- )")
_CUT_HUNKS = re.compile(r"\n(?=@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@)")
_CONSUMED = re.compile(r"\n(?:\+\+\+ |Binary files).*")
_LINE_ENDS = str.maketrans(dict.fromkeys(OTHER_LINE_ENDS, "\n"))
_CHANGED_LINE = re.compile(rf"(?m)^{CHANGED_MARK}.*")
#: Numbers of 32 bits that a line's hash consists of.
LANES = 4


def _cut_hunks(segment: str) -> list[str]:
    if "\n+++ " in segment or "\nBinary files" in segment:
        segment = _CONSUMED.sub("", segment)
    return _CUT_HUNKS.split(segment) if "\n@@ -" in segment else [segment]


def cut_piece(content: str) -> list[tuple[str, list[str]]]:
    """Each part of a file in a piece, and its hunks; hunk 0 is what precedes the first one."""
    text = "\n" + content.replace("\r\n", "\n").translate(_LINE_ENDS)
    return [(segment, _cut_hunks(segment)) for segment in _CUT_FILES.split(text.removesuffix("\n"))]


def hunks_of_parts(parts: list[tuple[str, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """``part, hunk, text``; hunk 0 is the rest of one begun earlier."""
    for part, (_, hunks) in enumerate(parts):
        if part == 0 and hunks[0]:
            # What a piece has before its first hunk or file begins with a line feed.
            yield part, 0, hunks[0][1:]
        for hunk in range(1, len(hunks)):
            yield part, hunk, hunks[hunk]


def count_changed(lines: str) -> tuple[int, int]:
    """Added and deleted lines of a text with a line feed before each line."""
    added, deleted = (lines.count("\n" + sign) - lines.count("\n" + 3 * sign) for sign in "+-")
    return added, deleted


def _paths(segment: str) -> tuple[str, str | None]:
    """Old and new path that a part names; the last new one counts."""
    old = re.split(r"[\t\n]", segment[4:], maxsplit=1)[0] if segment.startswith("--- ") else ""
    at = segment.rfind("\n+++ ")
    return old, re.split(r"[\t\n]", segment[at + 5 :], maxsplit=1)[0] if at >= 0 else None


def _part(part: int, segment: str, hunks: list[str]) -> tuple:
    """The numbers of :func:`diffloom.operators.pieces.piece_parts` for one part."""
    old, new = _paths(segment)
    return (
        part, old if part else None, new, "\nBinary files" in segment, len(hunks) - 1,
        *count_changed("".join(["\n" + hunk for hunk in hunks[1:]])),
        *(count_changed("\n" + hunks[0]) if part == 0 else (0, 0)),
    )


def noise_pattern(starts: list[str]) -> re.Pattern:
    """A changed line that is neither blank nor begins with a comment token."""
    harmless = "|".join(["$", *map(re.escape, starts)])
    return re.compile(rf"(?m)^{CHANGED_MARK}(?![{BLANK}]*+(?:{harmless}))")


def line_sums(hunk: str) -> list[int]:
    """Sums over the hashes of the token lists of added less removed lines, a number for each lane."""
    signed: Counter[str] = Counter()
    for line in _CHANGED_LINE.findall(hunk):
        signed[" ".join(line[1:].split())] += 1 if line[0] == "+" else -1
    sums = [0] * LANES
    for tokens, times in signed.items():
        if times:
            lanes = unpack(f"<{LANES}I", md5(tokens.encode(), usedforsecurity=False).digest())
            sums = [total + times * lane for total, lane in zip(sums, lanes)]
    return sums


_PART = [("part", pa.int64()), ("old_path", pa.string()), ("new_path", pa.string()), ("binary", pa.bool_())]
_PART += [(name, pa.int64()) for name in ("hunks", "added", "deleted", "head_added", "head_deleted")]


def _lists(rows: list[list[tuple] | None], kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Lists of structs, null for None."""
    offsets, total = [], 0
    for own in rows:
        offsets.append(None if own is None else total)
        total += len(own or ())
    columns = [*zip(*[row for own in rows for row in own or ()])] or [()] * len(kinds)
    fields = [pa.array(values, kind) for values, (_, kind) in zip(columns, kinds)]
    structs = pa.StructArray.from_arrays(fields, [name for name, _ in kinds])
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), structs)


def describe_batches(dialects: list[list[str]], names: list[str]):
    """Function for ``mapInArrow``: ``patch_id, piece_no, content`` to ``patch_id, piece_no, parts, states``."""
    kinds = [(name, pa.int64()) for name in ("part", "hunk", "added", "deleted", "lines", "chars")]
    kinds += [(f"sum_{lane}", pa.int64()) for lane in range(LANES)] + [(name, pa.bool_()) for name in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [noise_pattern(starts) for starts in dialects]

        def state(part: int, hunk: int, text: str) -> tuple:
            lines = "\n" + text
            added, deleted = count_changed(lines)
            count = lines.count("\n")
            sums = line_sums(text) if added or deleted else [0] * LANES
            clean = [not pattern.search(text) for pattern in patterns]
            return part, hunk, added, deleted, count, len(lines) - count, *sums, *clean

        for batch in batches:
            parts_of, states_of = [], []
            contents = batch.column("content")
            for row in range(batch.num_rows):
                content = contents[row].as_py()
                parts = None if content is None else cut_piece(content)
                parts_of.append(parts and [_part(i, *own) for i, own in enumerate(parts)])
                states_of.append(parts and [state(*own) for own in hunks_of_parts(parts)])
            columns = [batch.column("patch_id"), batch.column("piece_no"), _lists(parts_of, _PART), _lists(states_of, kinds)]
            yield pa.record_batch(columns, ["patch_id", "piece_no", "parts", "states"])

    return work


def _extension(segment: str) -> str:
    """Extension of the file whose header is the segment's first line."""
    old, new = _paths(segment)
    path = (old if new == "/dev/null" else new or "").removeprefix("b/").removeprefix("a/")
    stem, dot, last = path.rstrip("/").rpartition("/")[2].rpartition(".")
    return last.lower() if stem and dot else ""


class _Rule:
    """A pattern and the literals one of which each of its matches has."""

    def __init__(self, pattern: str, parenthesis: bool) -> None:
        compiled = re.compile(pattern)
        self.find = compiled.match if pattern.startswith("^") else compiled.search
        self.words = tuple(required_words(pattern) or (["("] if parenthesis else [""]))


def symbol_batches(needs_parenthesis: dict[str, bool]):
    """Function for ``mapInArrow``: the first line and rule of each symbol, a row for each piece, hunk and language."""
    kinds = [("part", pa.int64()), ("hunk", pa.int64())]
    kinds += [("language", pa.string()), ("symbol", pa.string()), ("line_no", pa.int32()), ("rule", pa.int32())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = {
            name: [_Rule(pattern, needs_parenthesis[pattern]) for pattern in patterns]
            for name, patterns in SYMBOL_PATTERNS.items()
        }
        of_extension = {e: [name] for name, known in SYMBOL_EXTENSIONS.items() for e in known}

        def describe(content: str):
            parts = cut_piece(content)
            known = [
                [*SYMBOL_EXTENSIONS] if part in (0, len(parts) - 1) else of_extension.get(_extension(segment), [])
                for part, (segment, _) in enumerate(parts)
            ]
            for part, hunk, text in hunks_of_parts(parts):
                lines = [line.lstrip("+-@ ") for line in text.split("\n")] if known[part] else []
                having: dict[tuple[str, ...], list[tuple[int, str]]] = {}
                for language in known[part]:
                    firsts: dict[str, tuple[int, int]] = {}
                    for rule, own in enumerate(rules[language]):
                        if own.words not in having:
                            there = [word for word in own.words if word in text]
                            having[own.words] = [
                                (at, line) for at, line in enumerate(lines) if any(word in line for word in there)
                            ]
                        for at, line in having[own.words]:
                            match = own.find(line)
                            symbol = match and next(filter(None, match.groups()), None)
                            if symbol and (symbol not in firsts or (at, rule) < firsts[symbol]):
                                firsts[symbol] = at, rule
                    for symbol, place in firsts.items():
                        yield part, hunk, language, symbol, *place

        for batch in batches:
            contents = batch.column("content")
            at, rows = [], []
            for row in range(batch.num_rows):
                content = contents[row].as_py()
                found = [] if content is None else [*describe(content)]
                rows += found
                at += [row] * len(found)
            if rows:
                places = pa.array(at, pa.int32())
                columns = [batch.column(name).take(places) for name in ("patch_id", "piece_no")]
                columns += [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), kinds)]
                yield pa.record_batch(columns, ["patch_id", "piece_no", *[name for name, _ in kinds]])

    return work
