"""Regular-expression dialect used by every rule in the package.

Rules are written in Python's ``re`` spelling.  Spark evaluates them with
``java.util.regex``, whose character classes and anchors differ, so
:func:`java_regex` rewrites the classes explicitly instead of relying on
engine flags (the flag ``(?U)`` counts combining marks as word characters
and leaves out U+001C..U+001F from white space).
"""

from __future__ import annotations

import re

# What Python calls a word character, white space and white space without LF.
WORD = r"\p{L}\p{N}_"
_SPACE_TAIL = r"\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\t-\r" + _SPACE_TAIL
BLANK = r"\t\x0b-\r" + _SPACE_TAIL
#: The characters of SPACE, one by one.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c))

_TOKEN = re.compile(r"\\.|\[\^?|\]|.", re.S)
_CLASSES = {r"\w": WORD, r"\s": SPACE, r"\d": r"\p{Nd}"}


def _boundary(before: str, after: str) -> str:
    if re.fullmatch(r"[A-Za-z0-9_]", after):
        return f"(?<![{WORD}])"
    if re.fullmatch(r"[A-Za-z0-9_]", before):
        return f"(?![{WORD}])"
    return f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java_regex(pattern: str, flags: str = "") -> str:
    """Translate a Python pattern; ``flags`` may hold ``i``, ``m`` and ``s``.

    ``d`` (only LF ends a line) is always on, as in Python.
    """
    tokens = _TOKEN.findall(pattern)
    out, in_class = [], False
    for i, tok in enumerate(tokens):
        if tok.startswith("[") and not in_class:
            in_class = True
        elif tok == "]":
            in_class = False
        elif tok in _CLASSES:
            tok = _CLASSES[tok] if in_class else f"[{_CLASSES[tok]}]"
        elif tok == r"\S" and not in_class:
            tok = f"[^{SPACE}]"
        elif tok == r"\b" and not in_class:
            before = tokens[i - 1] if i else ""
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            tok = _boundary(before, after)
        out.append(tok)
    return f"(?d{'iu' if 'i' in flags else ''}{flags.replace('i', '')}){''.join(out)}"


def required_words(pattern: str) -> list[str] | None:
    """One literal for each top-level alternative that every match must contain.

    Looking for literals is much cheaper than running a regular expression, and
    most texts contain none of them.  None means that a literal is not evident.
    """
    words, depth, plain = [], 0, [""]
    for tok in re.findall(r"\\.|\[\^?[^\]]*\]|.", pattern, re.S):
        if tok == "(":
            depth += 1
        elif tok == ")":
            depth -= 1
        elif tok == "|" and depth == 0:
            words.append(plain)
            plain = [""]
            continue
        elif depth == 0 and tok in "?*{":
            # The character before a quantifier that allows zero may be absent.
            plain[-1] = plain[-1][:-1]
        elif depth == 0 and re.fullmatch(r"[A-Za-z_@:]", tok):
            plain[-1] += tok
            continue
        plain.append("")
    longest = [max(runs, key=len) for runs in [*words, plain]]
    return longest if all(longest) else None
