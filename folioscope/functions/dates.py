"""Dates as printed, in five languages: a line is cut into tokens once, and a small table of token
sequences says what reads as a date."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_text
from .tokens import Token, small, spelled, tokens

# How the months begin, in English, Spanish, Ukrainian, Russian and Greek.
MONTHS = {
    1: "jan ene січ янв ιαν", 2: "feb лют фев φεβ φλεβ", 3: "mar берез мар μαρ", 4: "apr abr квіт апр απρ",
    5: "may травен травн май мая μαι", 6: "jun черв июн ιουν", 7: "jul лип июл ιουλ", 8: "aug ago серп авг αυγ",
    9: "sep set верес сен σεπ", 10: "oct жовт окт οκτ", 11: "nov листоп ноя νοε", 12: "dec dic груд дек δεκ",
}
# Words that say "this was done then".
INTRODUCING = "від от с з from del de στις дата".split()
ROMAN = {r: k for k, r in enumerate("i ii iii iv v vi vii viii ix x xi xii".split(), 1)}
_TO_ROMAN = str.maketrans("іху", "ixv")
_STEMS = spelled({month: [*stems.split(), *map(fold_text, stems.split())] for month, stems in MONTHS.items()})
_LENGTHS = sorted({len(s) for s in _STEMS}, reverse=True)
_INTRODUCING = {fold_text(s) for s in spelled({w: [w] for w in INTRODUCING})}
_PARTING = ".-/–"


def month_of(word: str) -> int | None:
    """The month that a word names: its longest known beginning decides."""
    folded = fold_text(word) or ""
    for n in _LENGTHS:
        for form in (word, folded):
            if (month := _STEMS.get(form[:n])) and len(form) >= n >= 3:
                return month
    return None


def full_year(text: str, today: date) -> int:
    """Two digits are of this century, unless that is still to come."""
    if len(text) > 2:
        return int(text)
    year = today.year // 100 * 100 + int(text)
    return year - 100 * (year > today.year)


class Found(NamedTuple):
    value: date
    precision: str  # day, month or year
    how: str  # numbers, year first, spaced, word, roman
    first: int  # of its tokens
    last: int
    ambiguous: bool = False
    month_first: bool = False


class Line:
    """The tokens of a line, and the sequences that read as dates from one of them on."""

    def __init__(self, text: str, today: date) -> None:
        self.small, self.tokens, self.today = small(text), tokens(text), today

    def at(self, k: int) -> Token:
        return self.tokens[k] if 0 <= k < len(self.tokens) else Token("", "", -1, -1, True)

    def digits(self, k: int, *sizes: int) -> bool:
        t = self.at(k)
        return t.kind == "n" and len(t.text) in sizes

    def sign(self, k: int, signs: str) -> bool:
        t = self.at(k)
        return t.kind == "s" and t.text in signs

    def over(self, k: int, signs: str, *words: str) -> int:
        """Past at most one of the signs, and one of the words."""
        k += self.sign(k, signs)
        return k + (self.at(k).text in words)

    def made(self, year: str, month: int | None, day: str = "1") -> date | None:
        try:
            return date(full_year(year, self.today), month or 0, int(day))
        except ValueError:
            return None

    def found(self, k: int) -> list[Found]:
        """What begins with token k."""
        t = self.at(k)
        if t.kind == "n":
            return [f for read in (self.numbers, self.roman, self.day_word, self.month_year, self.year) if (f := read(k))]
        return [f for read in (self.word_day, self.word_year) if (f := read(k))] if t.kind == "w" and month_of(t.text) else []

    def numbers(self, k: int) -> Found | None:
        """Three numbers over one sign, or apart by blanks alone."""
        sign = self.at(k + 1).text if self.sign(k + 1, "./-") else ""
        step = 2 if sign else 1
        places = (k, k + step, k + 2 * step)
        if sign and self.at(k + 3).text != sign:
            return None
        if self.digits(k, 4) and sign and self.digits(places[1], 1, 2) and self.digits(places[2], 1, 2):
            value = self.made(self.at(k).text, int(self.at(places[1]).text), self.at(places[2]).text)
            return value and Found(value, "day", "year first", k, places[2])
        years = (2, 4) if sign else (4,)
        clock = self.sign(k - 1, ":") and not self.at(k).gap or self.sign(places[2] + 1, ":") and not self.at(places[2] + 1).gap
        if not (self.digits(k, 1, 2) and self.digits(places[1], 1, 2) and self.digits(places[2], *years)) or clock:
            return None
        a, b, year = (self.at(p).text for p in places)
        month_first = int(a) <= 12 < int(b)
        value = self.made(year, int(a if month_first else b), b if month_first else a)
        swapped = max(int(a), int(b)) <= 12 and int(a) != int(b)
        return value and Found(value, "day", "numbers" if sign else "spaced", k, places[2], swapped, month_first)

    def roman(self, k: int) -> Found | None:
        word = self.over(k + 1, _PARTING)
        year = self.over(word + 1, _PARTING)
        month = ROMAN.get(self.at(word).text.translate(_TO_ROMAN))
        apart = lambda a, b: b > a + 1 or self.at(b).gap
        if not (month and self.digits(k, 1, 2) and self.digits(year, 2, 4) and apart(k, word) and apart(word, year)):
            return None
        value = self.made(self.at(year).text, month, self.at(k).text)
        return value and Found(value, "day", "roman", k, year)

    def day_word(self, k: int) -> Found | None:
        """19 січня 2019, 10-NOV-2021, 1º de marzo de 2019."""
        word = self.over(k + 1, "°")
        word = self.over(word, _PARTING, "de")
        t = self.at(word)
        month = month_of(t.text) if t.kind == "w" else None
        year = self.over(word + 1, ".")
        year = self.over(year, ",")
        year = self.over(year, _PARTING, "de")
        if not (month and self.digits(k, 1, 2) and self.digits(year, 2, 4)):
            return None
        value = self.made(self.at(year).text, month, self.at(k).text)
        return value and Found(value, "day", "word", k, year)

    def word_day(self, k: int) -> Found | None:
        """February 3, 2026."""
        day = self.over(k + 1, ".")
        year = self.over(day + 1, "", "st", "nd", "rd", "th")
        year = self.over(year, ",")
        if not (self.digits(day, 1, 2) and self.digits(year, 4) and self.at(day).gap and self.at(year).gap):
            return None
        value = self.made(self.at(year).text, month_of(self.at(k).text), self.at(day).text)
        return value and Found(value, "day", "word", k, year)

    def word_year(self, k: int) -> Found | None:
        year = self.over(k + 1, ".")
        year = self.over(year, "," + _PARTING, "de")
        if not self.digits(year, 4):
            return None
        value = self.made(self.at(year).text, month_of(self.at(k).text))
        return value and Found(value, "month", "word", k, year)

    def month_year(self, k: int) -> Found | None:
        """10.2015; 08.89 only where the second number is no month."""
        year = self.at(k + 2).text
        if not (self.digits(k, 1, 2) and self.sign(k + 1, "./") and self.digits(k + 2, 2, 4) and (len(year) == 4 or int(year) > 12)):
            return None
        before, after = self.sign(k - 1, "./") and not self.at(k).gap, self.sign(k + 3, "./") and self.at(k + 4).kind == "n"
        if before or after or len(year) == 2 and (self.at(k - 1).kind or self.at(k + 3).kind):  # a short year stands alone
            return None
        value = self.made(year, int(self.at(k).text))
        return value and Found(value, "month", "numbers", k, k + 2)

    def year(self, k: int) -> Found | None:
        if not (self.digits(k, 4) and self.at(k).text[:2] in ("19", "20")) or self.sign(k - 1, ",") and not self.at(k).gap:
            return None
        return Found(date(int(self.at(k).text), 1, 1), "year", "numbers", k, k)

    def introduced(self, one: Found) -> bool:
        """Whether somebody put it there on purpose: at the start of the line, behind a word that introduces
        dates, or in brackets that hold no other number."""
        before = self.tokens[: one.first]
        if all(t.text in "([" for t in before):
            return True
        said = [t for t in before if t.kind != "s"]
        if said and fold_text(said[-1].text) in _INTRODUCING:
            return True
        opened = next((k for k in range(one.first - 1, -1, -1) if self.sign(k, "()")), None)
        closed = next((k for k in range(one.last + 1, len(self.tokens)) if self.sign(k, "()")), None)
        if opened is None or closed is None or not self.sign(opened, "(") or not self.sign(closed, ")"):
            return False
        colon = next((k for k in range(one.last + 1, closed) if self.sign(k, ":")), closed)
        return all(t.kind != "n" for k, t in enumerate(self.tokens[opened:colon], opened) if not one.first <= k <= one.last)


_RANK = {"day": 0, "month": 1, "year": 2}


def read_date(text: str | None, today: date, language: str | None = None) -> dict | None:
    """value, precision (day, month, year) and ambiguous; the finest, then first, then longest reading.

    `today` says which century a short year is of.  Day and month may be swapped where both are 12
    at most: in a text in English, or, where no language is given, over slashes.
    """
    line = Line(text or "", today)
    every = [f for k in range(len(line.tokens)) for f in line.found(k)]
    if not every:
        return None
    best = min(every, key=lambda f: (_RANK[f.precision], f.first, -f.last))
    swapped = best.ambiguous and (language == "en" if language else line.sign(best.first + 1, "/"))
    return {"value": best.value, "precision": best.precision, "ambiguous": swapped}


#: Lines of at most so many characters are remembered with what was read of them.
KEPT_CHARS = 200
#: A date nearer to the document's own than this is of the same visit; one further after it is none.
APART_DAYS, AHEAD_DAYS, EARLIEST = 31, 3, 1900


def quoted_date(text: str | None, document: date | None, apart: int = APART_DAYS, ahead: int = AHEAD_DAYS) -> date | None:
    """The day on which what a line retells was done, where the line names another than the document's.

    A line is full of numbers that are no dates, so each shape has to earn it.  Three numbers over one
    sign touch no letter or further sign; with a short year all three have two digits; month
    first wants an introduction, and so does a month without a day.  Month and year are never over
    a dash, which prints ranges.  A Roman month is printed tight, since x multiplies.
    """
    if not text or not document:
        return None
    told = _told_kept(text, document.year) if len(text) <= KEPT_CHARS else _told(text, document.year)
    return next((d for d in told if (d - document).days <= ahead and (document - d).days > apart), None)


def _told(text: str, year: int) -> Iterator[date]:
    """The days that a line of a document of that year may retell, best first."""
    line = Line(text, date(year + 1, 1, 1))
    every = [f for k in range(len(line.tokens)) for f in line.found(k) if f.how != "spaced" and f.precision != "year"]
    days = [f for f in every if f.precision == "day"]
    every = [f for f in every if f.precision == "day" or not any(d.first <= f.first and f.last <= d.last for d in days)]

    def free(f: Found) -> bool:
        """Touched by no letter or sign of dates before, and by no digit or sign of dates after."""
        before, after = line.at(f.first - 1), line.at(f.last + 1)
        touched = not line.at(f.first).gap and (before.kind == "w" or before.text in tuple("/.-"))
        return not touched and (after.gap or after.text not in tuple("/.-") or line.at(f.last + 2).gap)

    def tight(f: Found) -> bool:
        return not any(t.gap for t in line.tokens[f.first + 1 : f.last + 1])

    def whole(f: Found) -> bool:
        if f.how == "year first":
            return tight(f) and free(f)
        day, month, year = (line.at(k).text for k in (f.first, f.first + 2, f.last))
        padded = len(year) == 4 or len(day) == len(month) == 2
        return f.how == "numbers" and f.precision == "day" and tight(f) and free(f) and padded and (not f.month_first or line.introduced(f))

    tests = [
        whole,
        lambda f: f.how == "numbers" and f.precision == "month" and tight(f) and free(f) and len(line.at(f.last).text) == 4 and line.introduced(f),
        lambda f: f.how == "roman" and tight(f),
        lambda f: f.how == "word" and f.precision == "day",
        lambda f: f.how == "word" and f.precision == "month" and line.introduced(f),
    ]
    yield from (f.value for test in tests for f in every if test(f) and f.value.year >= EARLIEST)


@lru_cache(maxsize=2**17)
def _told_kept(text: str, year: int) -> tuple[date, ...]:
    """Forms print the same lines over and over: a worker reads a short one once while it remembers it."""
    return tuple(_told(text, year))


def day_or_month_first(text: str | None, today: date) -> str | None:
    """Which way round the numeric date printed here can only be read: "day first", "month first"; null for
    either way, or for no date."""
    line = Line(text or "", today)
    for k in range(len(line.tokens)):
        one = line.numbers(k) if line.at(k).kind == "n" else None
        if one and one.how != "year first" and not one.ambiguous:
            if one.month_first:
                return "month first"
            if int(line.at(one.first).text) > 12:
                return "day first"
    return None


#: What every line that quoted_date() can read has: three numbers over signs, a month and a whole year,
#: or a word or Roman number before a year.
_MAY_BE_DATED = r"\d[./-]\d{1,2}[./-]\d|\d[./]\d{4}|\p{L}[^\p{L}\d]{0,4}(?:de\s+)?(?:\d{4}|\d{2}(?!\d))|\p{L}\.?\s+\d{1,2}\p{L}{0,2},?\s+\d{4}"


def quoted_dates(line: Column, document: Column, apart: int = APART_DAYS, ahead: int = AHEAD_DAYS) -> Column:
    """quoted_date() of each row.  Only lines that may hold a date are read; the others cost nothing in Python."""

    @F.pandas_udf("date")
    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lines, days in parts:
            out = pd.Series([None] * len(lines), index=lines.index, dtype=object)
            asked = lines.notna() & days.notna()
            out[asked] = [quoted_date(t, d, apart, ahead) for t, d in zip(lines[asked], days[asked], strict=True)]
            yield out

    return read(F.when(line.rlike(_MAY_BE_DATED), line), document)
