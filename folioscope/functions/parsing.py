"""Parsers of printed strings over columns, and conversions of units.

Each parser is a small function of one string.  on_distinct() runs it over the different strings of
a column, where they are far fewer than its rows, and joins the answers back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .dates import quoted_date, read_date  # noqa: F401
from .ranges import outside, printed_ends, read_range  # noqa: F401
from .units import unit_key, unit_of_range  # noqa: F401


def on_distinct(rows: DataFrame, columns: list[str], parse: Callable[..., dict | None], fields: str, prefix: str = "") -> DataFrame:
    """rows with the fields that parse(*columns) gives, null where it gives None.

    The parser sees each different combination once.  The answers are staged, so rows meet them, null
    matching null, in a join of known size: where they are few, no row is shuffled.
    """
    names = [f.split()[0] for f in re.split(r",\s*(?![^<]*>)", fields)]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [parse(*(None if v is None or v is pd.NA or v != v else v for v in row)) or {} for row in part.itertuples(index=False)]
            for name in names:
                part[prefix + name] = pd.Series([a.get(name) for a in answers], index=part.index, dtype=object)
            yield part

    asked = rows.select(*columns).distinct()
    schema = ", ".join([f"{c} {t}" for c, t in asked.dtypes] + [prefix + f.strip() for f in re.split(r",\s*(?![^<]*>)", fields)])
    keys = {c: f"_key_{k}" for k, c in enumerate(columns)}
    answers = staged(asked.mapInPandas(work, schema).withColumnsRenamed(keys))
    same = F.lit(True)
    for c, k in keys.items():
        same = same & rows[c].eqNullSafe(answers[k])
    return rows.join(answers, same, "left").drop(*keys.values())


# ------------------------------------------------------------------ units

# Molar masses in g/mol, for conversions to mmol/l; None where mass is kept.
MOLAR_MASS = {
    "glucose": 180.16, "cholesterol": 386.65, "triglyceride": 885.4, "creatinine": 113.12, "urea": 60.06, "uric acid": 168.11,
    "bilirubin": 584.66, "calcium": 40.08, "phosphate": 30.97, "magnesium": 24.305, "iron": 55.845,
}
MOLES = {"mol/l": 1e3, "mmol/l": 1.0, "umol/l": 1e-3, "nmol/l": 1e-6}
GRAMS = {"g/l": 1e3, "g/dl": 1e4, "mg/l": 1.0, "mg/dl": 10.0, "ug/dl": 1e-2, "ug/l": 1e-3, "ng/ml": 1e-3}


def to_mmol(analyte: str | None, unit: str | None) -> dict | None:
    """The factor that brings a value of the analyte in this unit (a key) to mmol/l."""
    if unit in MOLES:
        return {"factor": MOLES[unit]}
    mass = MOLAR_MASS.get(analyte or "")
    return {"factor": GRAMS[unit] / mass} if mass and unit in GRAMS else None


def power_of(unit: str | None) -> int | None:
    """The power of ten per litre that a count unit (a key) says, if it says one."""
    m = re.fullmatch(r"(?:10\^(\d+))?/(l|ml|ul)", unit or "")
    return int(m[1] or 0) + {"l": 0, "ml": 3, "ul": 6}[m[2]] if m and (m[1] or m[2] != "l") else None
