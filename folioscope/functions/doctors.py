"""Doctors that pages name: a label or an honorific, what may stand between, and a name that proves itself.

A name proves itself by its shape alone: initials, or a patronymic behind two names, or capitals behind
an honorific.  A table function, since a page has any number of readings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dates import KEPT_CHARS
from .text import fold_text

# Who saw, performed or signed; a dash ends what is the beginning of a word, a dot belongs to it.
SIGNED = "лікар лікаря лікарь врач доктор завідувач- завідуюч- заведующ- зав. виконав- исполнитель відповідальн- médico medico facultativo firmado fdo. dr dra doctor physician".split()
# Who sent the person.
REFERRED = ["фио врача", "піб лікаря", "направив-", "напрям-", "направил-", "παραπεμπων ιατρος", "referring physician", "referring doctor", "referred by", "sent by", "médico solicitante", "solicita-"]
# Honorifics, degrees, and how patronymics end.
HONORIFICS = "dr dra d-r д-р δρ prof".split()
DEGREES = ["к м н", "д м н", "м н с", "с н с", "проф", "доц", "д-р"]
PATRONYMICS = "ович евич йович ьович івич овна евна ївна івна инична ічна".split()
#: Labels that are honorifics as well: what follows is a name without initials too.
_BOTH = ("dr", "dra", "doctor", "physician")

_CUT = re.compile(r"[^\W\d_]+(?:['’ʼ`-][^\W\d_]+)*|\d+|[^\s\w]|_")
_NOTE = re.compile(r"\[[^\]]*\]|\([^)]*\)")


class Piece(NamedTuple):
    text: str
    folded: str
    start: int
    end: int


def _pieces(line: str) -> list[Piece]:
    plain = _NOTE.sub(lambda m: " " * len(m[0]), line)
    return [Piece(m[0], fold_text(m[0]) or "", m.start(), m.end()) for m in _CUT.finditer(plain)]


def _said(pieces: list[Piece], k: int, phrase: str) -> int:
    """Past the phrase if it stands at k, its words parted by dots or not; else 0."""
    for n, word in enumerate(phrase.split()):
        while n and k < len(pieces) and pieces[k].text == ".":
            k += 1
        if k >= len(pieces):
            return 0
        dotted, begins = word.endswith("."), word.endswith("-") and len(word) > 3
        want = fold_text(word.rstrip(".") if dotted else word[:-1] if begins else word) or ""
        if not (pieces[k].folded.startswith(want) if begins else pieces[k].folded == want):
            return 0
        k += 1
        if dotted:
            if k >= len(pieces) or pieces[k].text != ".":
                return 0
            k += 1
    return k


def _firsts(phrases: list[str]) -> tuple[frozenset[str], tuple[str, ...]]:
    """What the phrases can begin with: whole words, and beginnings of words."""
    words = [p.split()[0] for p in phrases]
    whole = frozenset(fold_text(w.rstrip(".")) or "" for w in words)
    return whole, tuple(fold_text(w[:-1]) or "" for w in words if w.endswith("-") and len(w) > 3)


_LABELS = [*HONORIFICS, *SIGNED]
_WHOLE, _BEGIN = _firsts(_LABELS)
_SENT_WHOLE, _SENT_BEGIN = _firsts(REFERRED)
_DEGREE_WHOLE = _firsts(DEGREES)[0]


def _is_capital(text: str, alphabet: str = "") -> bool:
    return text[:1].isupper() and (not alphabet or alphabet in unicodedata.name(text[0], ""))


class _Names:
    """Readers of a name at a piece: each gives the piece past it, or 0."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces

    def at(self, k: int) -> str:
        return self.pieces[k].text if 0 <= k < len(self.pieces) else ""

    def word(self, k: int, alphabet: str = "") -> bool:
        return len(self.at(k)) > 1 and _is_capital(self.at(k), alphabet) and not self.at(k)[1:].isupper()

    def initials(self, k: int, dots: int) -> int:
        """Past one or two initials; of the last, the dot may be lost if `dots` is 1."""
        first = len(self.at(k)) == 1 and _is_capital(self.at(k)) and self.at(k + 1) == "."
        if not first:
            return 0
        second = len(self.at(k + 2)) == 1 and _is_capital(self.at(k + 2)) and self.near(k + 1)
        if second and self.at(k + 3) == ".":
            return k + 4
        return k + 3 if second and dots == 1 else k + 2

    def near(self, k: int) -> bool:
        """Whether what follows piece k is two blanks away at most."""
        return self.pieces[k + 1].start - self.pieces[k].end <= 2

    def surname_then_initials(self, k: int) -> int:
        return self.initials(k + 1, 1) if self.word(k) and len(self.at(k + 1)) == 1 else 0

    def initials_then_surname(self, k: int) -> int:
        past = self.initials(k, 2)
        return past + 1 if past and self.word(past) else 0

    def three_part(self, k: int) -> int:
        whole = all(self.word(j, "CYRILLIC") for j in (k, k + 1, k + 2))
        return k + 3 if whole and any(self.at(k + 2).lower().endswith(p) for p in PATRONYMICS) else 0

    def latin(self, k: int) -> int:
        """Two or three capitalised words; of four or more, nobody can say where the name ends."""
        start = past = self.initials(k, 2) or k
        while self.word(past, "LATIN"):
            past += 1
        return past if 2 <= past - start <= 3 else 0

    def latin_caps(self, k: int) -> int:
        past = k
        while len(self.at(past)) > 1 and self.at(past).isupper() and _is_capital(self.at(past), "LATIN"):
            past += 1
        return past if 2 <= past - k <= 3 else 0


PROOFS = ("surname_then_initials", "initials_then_surname", "three_part")
SHAPES = (*PROOFS, "latin", "latin_caps")


def _past_filler(pieces: list[Piece], k: int) -> Iterator[int]:
    """The places behind a label at which a name may begin: past signs, degrees, words in small letters and
    the initials of a department."""
    while True:
        yield k
        if k >= len(pieces):
            return
        text = pieces[k].text
        past = next((p for d in DEGREES if (p := _said(pieces, k, d))), 0) if pieces[k].folded in _DEGREE_WHOLE else 0
        if past:
            k = past + (past < len(pieces) and pieces[past].text == ".")
        elif text in tuple(":：-_/\\|.,;()№") or text.isalpha() and text.islower() and len(text) > 2:
            k += 1
        elif text.isalpha() and text.isupper() and 2 <= len(text) <= 5 and (k + 1 == len(pieces) or pieces[k + 1].text != "."):
            k += 1
        else:
            return


def readings(text: str | None) -> Iterator[tuple[str, str, str, str]]:
    """(name, label, shape, line) of each doctor that a text names, a name once a line.

    Names behind a label of whoever sent the person are theirs and not read.
    """
    for line in (text or "").split("\n"):
        yield from _of_line_kept(line) if len(line) <= KEPT_CHARS else _of_line(line)


@lru_cache(maxsize=2**16)
def _of_line_kept(line: str) -> tuple[tuple[str, str, str, str], ...]:
    """Forms print the same lines over and over: a worker reads a short one once while it remembers it."""
    return tuple(_of_line(line))


def _of_line(line: str) -> Iterator[tuple[str, str, str, str]]:
    pieces = _pieces(line)
    names = _Names(pieces)
    may_send = (k for k, p in enumerate(pieces) if p.folded in _SENT_WHOLE or p.folded.startswith(_SENT_BEGIN))
    sent = min((k for k in may_send for p in REFERRED if _said(pieces, k, p)), default=len(pieces))
    told = set()
    for k in range(min(sent, len(pieces))):
        if pieces[k].folded not in _WHOLE and not pieces[k].folded.startswith(_BEGIN):
            continue
        past, label = 0, ""
        for phrase in _LABELS:
            if (p := _said(pieces, k, phrase)) and p > past:
                past, label = p, phrase
        degree = past and fold_text("доктор") == pieces[k].folded and past < len(pieces) and pieces[past].folded.startswith(("медиц", "медич"))
        glued = k and pieces[k - 1].text == "." and pieces[k - 1].end == pieces[k].start
        if not past or degree or glued:
            continue
        honorific = label in HONORIFICS or label in _BOTH
        for at in _past_filler(pieces, past):
            shape, end = next(((s, e) for s in (SHAPES if honorific else PROOFS) if (e := getattr(names, s)(at))), ("", 0))
            if end:
                if at < sent:
                    name = re.sub(r"\s+", " ", line[pieces[at].start : pieces[end - 1].end])
                    if name not in told:
                        told.add(name)
                        yield name, line[pieces[k].start : pieces[past - 1].end], shape, line.strip()
                break


@F.udtf(returnType="name string, label string, shape string, line string")
class DoctorsInText:
    """The readings of one page, for a lateral join."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str, str]]:
        yield from readings(text)


#: What every page with a reading has, whatever its letters' case.
_MAY_NAME = r"(?iu)лікар|врач|доктор|завіду|заведу|зав\.|викона|исполн|відпов|m[ée]dico|facultat|firmado|fdo|dr|d-r|д-р|δρ|prof|physician"


def doctors_in_text(pages: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(id, name, label, shape, line): a row for each reading, by a table function in a lateral join.  Only pages
    that hold a label reach Python."""
    asked = pages.where(F.col(text_col).rlike(_MAY_NAME)).select(id_col, F.col(text_col).alias("_text"))
    return asked.lateralJoin(DoctorsInText(F.col("_text").outer())).drop("_text")
