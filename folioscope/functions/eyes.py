"""Eyes and what is measured of them, in the words of forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of oculus, and those that say which, in any of the alphabets.
FIRST = "oоο"
WHICH = {"the right eye": "dд", "the left eye": "sсc", "both eyes": "uуy"}
# What forms call each measurement.
MEASURES = {
    "visual acuity": "visus vis візус визус", "sphere": "sphere сфера сфер sph сф esfera esf σφαίρα σφ", "cylinder": "cylinder циліндр цилиндр cyl цил ціл cilindro cil κύλινδρος κυλ",
    "axis": "axis ось осі оси ax ах eje άξονας άξων",
}
# Of these, the ordinary words, which say something only beside another.
ORDINARY = "ось осі оси ах eje άξονας άξων".split()

_GREEK = ("άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ")


def _small(text: Column) -> Column:
    """Small letters, Greek without accents; nothing else is folded, since the axis must not fold onto an eye."""
    return F.translate(F.lower(text), *_GREEK)


def _plain(word: str) -> str:
    return word.translate(str.maketrans(*_GREEK))


_WORDS = {_plain(w): measure for measure, words in MEASURES.items() for w in words.split()}
_ANY = "(?:" + "|".join(map(re.escape, sorted(_WORDS, key=len, reverse=True))) + ")"


def the_eye_alone(name: Column) -> Column:
    """Which eye, where a name is nothing but an eye and signs; else null."""
    letters = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    out = F.when(F.lit(False), F.lit(""))
    for eye, second in WHICH.items():
        out = out.when(letters.rlike(f"^[{FIRST}][{second}]$"), eye)
    return out


def measurements_named(line: Column) -> Column:
    """The measurements that a line names beside a number, each once, in order.

    A word has the stretch of the line up to the next such word, and counts if a digit stands there.
    """
    pieces = F.split(_small(F.coalesce(line, F.lit(""))), rf"(?<!\p{{L}})(?={_ANY}(?!\p{{L}}))")
    word = lambda p: F.regexp_extract(p, rf"^({_ANY})(?!\p{{L}})", 1)
    said = F.transform(F.filter(pieces, lambda p: (word(p) != "") & p.rlike(r"\d")), word)
    table = F.create_map(*[F.lit(x) for pair in _WORDS.items() for x in pair])
    own = F.exists(said, lambda w: ~w.isin([_plain(w) for w in ORDINARY]))
    return F.when(own, F.array_distinct(F.transform(said, lambda w: table[w]))).otherwise(F.array().cast("array<string>"))
