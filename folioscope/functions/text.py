"""Text as column expressions: folding over five alphabets, words, look-alike letters, snippets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the fold: signs that vanish, and letters that count as one.
APOSTROPHES = "'`´ʹʼʽ‘’′"
MERGED = {"і": "и", "ї": "и", "ы": "и", "й": "и", "є": "е", "ё": "е", "э": "е", "ґ": "г"}
DROPPED = "ъь"
# Letters that look alike in Latin, Cyrillic and Greek, upper case.
LATIN_TWINS = "ABCEHIKMOPTXY"
CYRILLIC_TWINS = "АВСЕНІКМОРТХУ"
GREEK_TWINS = "ΑΒ ΕΗΙΚΜΟΡΤΧΥ"


def _folded_letter(c: str) -> str:
    bare = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
    return "".join(MERGED.get(x, x) for x in bare if x not in DROPPED)


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """From a rule over the Latin, Greek and Cyrillic blocks: letters that fold to one letter, and
    those that fold to several."""
    one, several = {}, {}
    for point in [*range(0xAA, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(point)
        if not unicodedata.category(c).startswith("L"):
            continue
        to = _folded_letter(c)
        if len(to) > 1:
            several[c] = to
        elif to and to != c:
            one[c] = to
    return "".join(one), "".join(one.values()), several


_FROM, _TO, _SEVERAL = _fold_tables()
_SMALL_SEVERAL = {c: to for c, to in _SEVERAL.items() if c == c.lower()}
_MARKS = r"[\x{0300}-\x{036F}]"


def fold(text: Column) -> Column:
    """The fold, as native expressions: case, apostrophes, accents, look-alike Cyrillic vowels.

    Covers Latin, Greek and Cyrillic letters; fold_exact() covers every script, at the price of an
    Arrow round trip.
    """
    plain = F.lower(F.replace(F.replace(text, F.lit("'"), F.lit("")), F.lit("`"), F.lit("")))
    out = F.translate(text, APOSTROPHES + DROPPED + DROPPED.upper(), "")
    out = F.translate(F.lower(out), _FROM, _TO)
    for c in "ßæœĳŉﬁﬂ":
        if c in _SMALL_SEVERAL:
            out = F.replace(out, F.lit(c), F.lit(_SMALL_SEVERAL[c]))
    # Letters go through a table one by one, so texts of plain letters take the short way.
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.regexp_replace(out, _MARKS, ""))


def fold_text(text: str | None) -> str | None:
    """The fold of one string, for tests and for questions that are folded on the driver."""
    if text is None:
        return None
    text = "".join(c for c in text.casefold() if c not in APOSTROPHES)
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(MERGED.get(c, c) for c in bare if c not in DROPPED)


@F.pandas_udf(T.StringType())
def fold_exact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(fold_text, na_action="ignore")


def fold_with_offsets(text: Column) -> Column:
    """(folded, offsets): the fold letter by letter, and for each letter of it the place of its origin."""
    pieces = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: fold(c))
    places = F.flatten(F.transform(pieces, lambda p, k: F.array_repeat(k, F.length(p))))
    return F.when(text.isNotNull(), F.struct(F.array_join(pieces, "").alias("folded"), places.alias("offsets")))


# Folded letters as an address can carry them.
ADDRESS = dict(zip("абвгдезиклмнопрстуфαβγδεζηικλμνξοπρστυφω", "abvhdezyklmnoprstufabgdeziiklmnxoprstyfo")) | {
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "θ": "th", "χ": "ch", "ψ": "ps", "ς": "s",
}


def address(text: Column, fallback: str = "a-name", longest: int = 40) -> Column:
    """A name as a file or an address can carry it: small Latin letters, digits and hyphens."""
    out = F.translate(fold(text), "".join(k for k, v in ADDRESS.items() if len(v) == 1), "".join(v for v in ADDRESS.values() if len(v) == 1))
    for k, v in ADDRESS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    plain = F.substring(F.btrim(F.regexp_replace(out, "[^a-z0-9]+", "-"), F.lit("-")), 1, longest)
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit(fallback)).otherwise(plain)


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


WORD = r"[\p{L}\p{N}]+"


def words(folded: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stems(folded: Column, letters: int = 5) -> Column:
    """The first letters of each word that has as many."""
    return F.array_distinct(F.transform(F.filter(words(folded), lambda w: F.length(w) >= letters), lambda w: F.substring(w, 1, letters)))


def mixed_script_words(text: Column) -> Column:
    """Words that hold Latin and Cyrillic letters at once."""
    every = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")
    return F.filter(every, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"\p{IsCyrillic}"))


def also_written_as(word: str) -> list[str]:
    """A word and, if each of its letters has a twin, the same in the other alphabets; digits stay."""
    out = [word]
    upper = word.upper()
    for own in (LATIN_TWINS, CYRILLIC_TWINS, GREEK_TWINS):
        if any(c.isalpha() for c in upper) and all(not c.isalpha() or c in own for c in upper):
            for other in (LATIN_TWINS, CYRILLIC_TWINS, GREEK_TWINS):
                twin = "".join(other[own.index(c)] if c.isalpha() else c for c in upper)
                if other is not own and " " not in twin:
                    out.append(twin.lower())
    return list(dict.fromkeys(out))


def unspaced(text: Column) -> Column:
    """Close up letter-spaced headings: single letters parted by single spaces, three or more."""
    closed = F.regexp_replace(text, r"(?<=(?<![\p{L}\p{N}])\p{L}) (?=\p{L}(?![\p{L}\p{N}]))", "")
    return F.when(text.rlike(r"(?<![\p{L}\p{N}])\p{L} \p{L} \p{L}(?![\p{L}\p{N}])"), closed).otherwise(text)


def snippet(text: Column, folded: Column, question_words: list[str], before: int = 80, width: int = 240) -> Column:
    """A window of the text about the first place of any question word longer than two letters."""
    places = [F.instr(folded, w) for w in question_words if len(w) > 2]
    if not places:
        return F.substring(text, 1, width)
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    return F.when(first.isNull(), F.substring(text, 1, width)).otherwise(text.substr(F.greatest(first - before, F.lit(1)), F.lit(width)))


def text_pages(text: Column, most: int = 5000) -> Column:
    """Cut a text into pages of about `most` characters at line ends; a longer line is cut hard."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}(?:\n|\z)|.{{1,{most}}}"), F.lit(0))
    return F.filter(pieces, lambda p: F.trim(p) != "")


def sliding_windows(text: Column, width: int = 20_000, overlap: int = 1_000) -> Column:
    """Overlapping windows (place, text) over a long text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(width - overlap))
    return F.transform(starts, lambda s: F.struct((s - 1).alias("place"), F.substr(text, s, F.lit(width)).alias("text")))
