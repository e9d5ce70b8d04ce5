"""A line cut into tokens: runs of digits, runs of letters, single signs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from typing import NamedTuple

from .text import LATIN_TWINS, CYRILLIC_TWINS, GREEK_TWINS, fold_text

_CUT = re.compile(r"\d+|[^\W\d_]+|[^\s\w]|_")


class Token(NamedTuple):
    kind: str  # n: digits, w: letters, s: a sign
    text: str
    start: int
    end: int
    gap: bool  # white space before it


def tokens(text: str) -> list[Token]:
    """The tokens of a text in small letters, quotation marks left out."""
    out, end = [], 0
    for m in _CUT.finditer(small(text)):
        c = m[0][0]
        out.append(Token("n" if c.isdigit() else "w" if c.isalpha() else "s", m[0], m.start(), m.end(), m.start() > end or not out))
        end = m.end()
    return out


def small(text: str) -> str:
    """Small letters, composed; quotation marks are blanks, ordinal signs degrees."""
    return unicodedata.normalize("NFC", text.casefold()).translate({ord(c): " " for c in "«»\"„“”'"} | {ord("º"): "°"})


def _twins() -> dict[str, str]:
    """The letters that each small letter may be mistaken for: those that look alike in another alphabet."""
    out: dict[str, str] = {}
    rows = [[*row.lower()] for row in (LATIN_TWINS, CYRILLIC_TWINS, GREEK_TWINS)]
    for alike in zip(*rows, strict=True):
        for c in alike:
            out[c] = out.get(c, "") + "".join(x for x in alike if x not in (c, " "))
    out.pop(" ", None)
    return out


TWINS = _twins()


def slips(word: str) -> list[str]:
    """word with one of its letters, and no more, in another alphabet.  A lone letter has none: in another
    alphabet it is a word of its own."""
    places = [k for k, c in enumerate(word) if c.isalpha()]
    if len(places) < 2:
        return []
    return list(dict.fromkeys(word[:k] + twin + word[k + 1 :] for k in places for twin in TWINS.get(word[k], "")))


def spelled(table: dict[object, Iterable[str]]) -> dict[str, object]:
    """What each spelling of a table (meaning: spellings) means, with the one-letter slips of each.

    A slip that two meanings could have is read as neither, folded or not; a spelling as given
    stays, whatever slips into it.
    """
    own = {word: meaning for meaning, words in table.items() for word in words}
    claims: dict[str, set] = {}
    made: dict[str, object] = {}
    for word, meaning in own.items():
        for spelling in (word, *slips(word)):
            made.setdefault(spelling, meaning)
            for shape in (spelling, fold_text(spelling)):
                claims.setdefault(shape, set()).add(meaning)
    return {s: m for s, m in made.items() if s not in own and len(claims[s] | claims[fold_text(s)]) == 1} | own
