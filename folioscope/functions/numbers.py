"""Numbers as printed: which values a text can stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"[\s\x{00A0}\x{202F}\x{2009}]"
_GROUPS = r"^[1-9]\d{0,2}"
TOKEN = r"\d+(?:[ \x{00A0}\x{202F}]\d{3}(?!\d))*(?:[.,]\d+)*|[.,]\d+"


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), for which x is evaluated once a row, however often f names it."""
    return F.transform(F.array(x), f)[0]


def _double(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def number(text: Column) -> Column:
    """One number with a decimal comma or point and spaces between groups; null if it is none."""
    return _double(F.replace(F.regexp_replace(text, _SPACES, ""), F.lit(","), F.lit(".")))


def readings(text: Column) -> Column:
    """The values a printed number can have, ascending: the marks may part thousands or decimals.

    1.234 is both 1.234 and 1234; 0,033 is 0.033 alone, since no group begins with 0.
    """

    def marks(t: Column) -> Column:
        dots = F.when(t.rlike(_GROUPS + r"(\.\d{3})+(,\d+)?$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        commas = F.when(t.rlike(_GROUPS + r"(,\d{3})+(\.\d+)?$"), F.replace(t, F.lit(","), F.lit("")))
        mark = F.when(t.rlike(r"^(\d+|\d*[.,]\d+)$"), F.replace(t, F.lit(","), F.lit(".")))
        return F.array(mark, dots, commas)

    printed = _once(F.regexp_replace(F.trim(text), _SPACES, ""), marks)
    finite = F.filter(F.transform(printed, lambda s: s.try_cast("double")), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.array_sort(F.array_distinct(finite))


def typewriter_digits(text: Column) -> Column:
    """Letters that a typewriter prints for one and nought, where they stand at digits and at no letter."""
    stands = lambda letters: rf"(?<!\p{{L}})[{letters}](?=[.,]?\d)|(?<=[\d.,])[{letters}](?!\p{{L}})"
    replaced = F.regexp_replace(F.regexp_replace(text, stands("IlІ"), "1"), stands("OoОо"), "0")
    return F.when(text.rlike("[IlІOoОо]"), replaced).otherwise(text)


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(typewriter_digits(text), F.lit(TOKEN), F.lit(0))


def reads_at_two_scales(text: Column) -> Column:
    return F.exists(number_tokens(text), lambda t: F.size(readings(t)) > 1)


def number_matches(text: Column, value: Column) -> Column:
    """Whether the stored value is one of the readings of one of the numbers in the text."""
    return F.when(_alone(text, value), True).otherwise(_one_is(number_tokens(text), value))


def number_differs(text: Column, value: Column) -> Column:
    """Whether the text has numbers, of which the stored value is no reading."""
    full = _once(number_tokens(text), lambda tokens: (F.size(tokens) > 0) & ~_one_is(tokens, value))
    return F.when(_alone(text, value), False).otherwise(full)


def _near(x: Column, value: Column) -> Column:
    return F.abs(x - value) <= 1e-9 * F.greatest(F.abs(x), F.abs(value), F.lit(1.0))


def _alone(text: Column, value: Column) -> Column:
    """Whether the text is one number, a sign before it or none, and the value is what its mark says:
    most are so, and then the other readings need not be made."""
    only = F.regexp_extract(text, r"^\s*[<>≤≥]?=?\s*(\d+(?:[.,]\d+)?)\s*$", 1)
    return _near(_double(F.replace(only, F.lit(","), F.lit("."))), value)


def _one_is(tokens: Column, value: Column) -> Column:
    return F.exists(tokens, lambda t: F.exists(readings(t), lambda x: _near(x, value)))


def number_as_printed(text: Column, low: Column, high: Column) -> Column:
    """The value of a text with a single number; if it can be two, the only one inside the range."""
    tokens = number_tokens(text)
    all_of = readings(F.element_at(tokens, 1))
    inside = F.filter(all_of, lambda x: (low.isNull() | (x >= low)) & (high.isNull() | (x <= high)))
    only = F.when(F.size(all_of) == 1, F.element_at(all_of, 1)).when((F.size(inside) == 1) & (low.isNotNull() | high.isNotNull()), F.element_at(inside, 1))
    return F.when(F.size(tokens) == 1, only)


def comparator_printed(text: Column) -> Column:
    """The sign before a number, if one is printed: <, <=, > or >=."""
    sign = F.regexp_extract(F.translate(text, "≤≥", "\x01\x02"), r"^\s*(<=|>=|<|>|\x01|\x02)", 1)
    return F.when(sign != "", F.replace(F.replace(sign, F.lit("\x01"), F.lit("<=")), F.lit("\x02"), F.lit(">=")))


def unexplained_letters(text: Column) -> Column:
    """Whether a numeric value holds letters other than an exponent."""
    return F.regexp_replace(text, r"(?i)(?<=\d)e[+-]?\d+", "").rlike(r"\p{L}")
