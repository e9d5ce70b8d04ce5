"""What a page states of a person: sex and dates of birth."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import KEPT_CHARS, Line, read_date
from .text import fold, fold_text

# Labels, and answers to them.
SEX_LABELS = "sex gender sexo стать пол φύλο".split()
SEX_ANSWERS = {
    "male": "male m hombre varón чоловіча чоловік мужской муж ч м άνδρας αρσενικό".split(),
    "female": "female f mujer жіноча женский жен ж γυναίκα θηλυκό".split(),
}
# Labels of a date of birth, word by word; a word that ends in a dash is how one begins.
BIRTH_LABELS = [
    "date of birth", "birth date", "birthdate", "dob", "d o b", "fecha de nacimiento", "дата рожд-", "год рожд-", "дата народж-", "рік народж-",
    "ημερομηνία γέννησης", "ημ γέννησης", "έτος γέννησης",
]
_BIRTH = [[fold_text(w) for w in label.split()] for label in BIRTH_LABELS]
#: What every page with such a label has, folded.
_MAY_TELL = "birth|dob|nacimiento|рожд|народж|γεννησ|" + r"d\W{0,3}o\W{0,3}b"
#: A date stands no further behind its label than this many characters.
WITHIN = 40


def sex_printed(text: Column) -> Column:
    """The answers to "sex" that a text states: an array of male and female, sorted.  The answer is the
    first word after the label, past one sign at most, on the same line."""
    words = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|\n|[^\s\p{L}]"), F.lit(0))
    labels, answers = [fold_text(w) for w in SEX_LABELS], {fold_text(w): sex for sex, said in SEX_ANSWERS.items() for w in said}

    def answer(word: Column, k: Column) -> Column:
        sign = F.get(words, k + 1).isin(":", "-")
        return F.when(word.isin(labels), F.when(sign, F.get(words, k + 2)).otherwise(F.get(words, k + 1)))

    said = F.transform(words, answer)
    known = [F.when(F.exists(said, lambda x: x.isin([w for w, s in answers.items() if s == sex])), F.lit(sex)) for sex in sorted(SEX_ANSWERS)]
    return F.transform(F.array_compact(F.array(*known)), lambda x: x)


def _labels(line: Line) -> list[tuple[int, int]]:
    """(first, past the last) token of each birth label; full stops between its words do not matter."""
    out = []
    words = [fold_text(t.text) for t in line.tokens]
    for k in range(len(words)):
        for label in _BIRTH:
            at = k
            for n, want in enumerate(label):
                while n and at < len(words) and words[at] == ".":
                    at += 1
                if at >= len(words) or not (words[at].startswith(want[:-1]) if want.endswith("-") else words[at] == want):
                    break
                at += 1
            else:
                out.append((k, at))
                break
    return out


def birth_dates_of(text: str, today: date) -> list[date]:
    """Of each label: the date that touches it in front, else the first one behind it, with one colon between
    them at most."""
    line, out = Line(text, today), set()
    small = line.small
    for first, past in _labels(line):
        start = line.tokens[first].start
        touching = [f for k in range(max(0, first - 5), first) for f in line.found(k) if f.last == first - 1 and not line.tokens[first].gap]
        if touching:
            out.add(min(touching, key=lambda f: f.first).value)
            continue
        end = line.tokens[past - 1].end
        number = next((t for t in line.tokens[past:] if t.kind == "n"), None)
        between = small[end : number.start] if number else ""
        if not number or number.start - end > WITHIN or between.count(":") > 1 or "\n" in between.strip(" \t:.") or start == end:
            continue
        back = next((t for t in reversed(line.tokens[past:]) if t.end <= number.start and t.kind == "w"), None)  # a month may stand first
        behind = small[back.start if back else number.start :].split("\n")[0]
        read = read_date(behind[: 60].split(":")[0], today) or read_date(small[number.start : number.start + 30].split(":")[0], today)
        if read:
            out.add(read["value"])
    return sorted(out)


@lru_cache(maxsize=2**16)
def _birth_dates_kept(text: str, today: date) -> tuple[date, ...]:
    """birth_dates_of() a short page: a worker reads the same one once while it remembers it."""
    return tuple(birth_dates_of(text, today))


def birth_dates(text: Column, today: date | None = None) -> Column:
    """The dates printed beside a date-of-birth label, sorted: in front of it where one touches it, else
    after it.  A year alone is its first of January.  `today` (the driver's, if none is given) says
    which century a short year is of."""
    now = today or date.today()

    @F.pandas_udf("array<date>")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: list(_birth_dates_kept(t, now)) if isinstance(t, str) and len(t) <= KEPT_CHARS else birth_dates_of(t, now) if isinstance(t, str) else [])

    return read(F.when(fold(text).rlike(_MAY_TELL), text))


def dates_disagree(dates: Column) -> Column:
    """Whether dates of birth cannot be one person's: different years, or two full dates in one year."""
    years = F.array_distinct(F.transform(dates, lambda d: F.year(d)))
    full = F.array_distinct(F.filter(dates, lambda d: ~((F.month(d) == 1) & (F.dayofmonth(d) == 1))))
    return F.coalesce((F.size(years) > 1) | (F.size(full) > 1), F.lit(False))
