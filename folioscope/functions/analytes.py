"""Which substance a value is of, in five languages, and the scale that its values are brought to."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .parsing import on_distinct
from .text import fold_text
from .tokens import spelled
from .units import unit_key

# The scale of each substance, and what one of another unit is worth on it.
SCALES = {
    "creatinine": ("umol/l", {"mg/dl": 88.4, "mmol/l": 1000.0, "umol/l": 1.0}), "urea": ("mmol/l", {"mg/dl": 0.1665, "mmol/l": 1.0, "umol/l": 0.001}), "glucose": ("mmol/l", {"mg/dl": 0.0555, "mmol/l": 1.0}),
    "uric acid": ("umol/l", {"mg/dl": 59.48, "mmol/l": 1000.0, "umol/l": 1.0}), "bilirubin": ("umol/l", {"mg/dl": 17.1, "mmol/l": 1000.0, "umol/l": 1.0}), "cholesterol": ("mmol/l", {"mg/dl": 0.02586, "mmol/l": 1.0}),
    "triglyceride": ("mmol/l", {"mg/dl": 0.01129, "mmol/l": 1.0}), "calcium": ("mmol/l", {"mg/dl": 0.2495, "mmol/l": 1.0}), "phosphate": ("mmol/l", {"mg/dl": 0.3229, "mmol/l": 1.0}),
    "magnesium": ("mmol/l", {"mg/dl": 0.4114, "mmol/l": 1.0}), "iron": ("umol/l", {"ug/dl": 0.1791, "umol/l": 1.0}), "protein": ("g/l", {"g/dl": 10.0, "g/l": 1.0}),
    "albumin": ("g/l", {"g/dl": 10.0, "g/l": 1.0}), "hemoglobin": ("g/l", {"g/dl": 10.0, "g/l": 1.0}),
}
# The tests whose scale it is, by their address; a ratio or another specimen's is no such test.
TESTS = {
    "creatinine": "creatinine", "urea": "urea", "glucose": "glucose fasting-glucose", "uric acid": "uric-acid", "bilirubin": "bilirubin total-bilirubin direct-bilirubin free-bilirubin",
    "cholesterol": "total-cholesterol hdl-cholesterol ldl-cholesterol non-hdl-cholesterol vldl-cholesterol", "triglyceride": "triglyceride", "calcium": "total-calcium calcium ionized-calcium",
    "phosphate": "phosphate phosphorus inorganic-phosphorus", "magnesium": "magnesium", "iron": "iron serum-iron", "protein": "total-protein protein", "albumin": "albumin", "hemoglobin": "hemoglobin",
}
# How forms name the substances.
NAMES = {
    "creatinine": "креатинин|креатинін|creatinin|creatinina|creatinine|kreatinin|κρεατινιν", "urea": "мочевина|сечовина|urea|ουρια|ουρία|harnstoff", "glucose": "глюкоз|цукор|glucos|glucosa|glukos|γλυκοζ|σακχαρ",
    "uric acid": "сечова кислота|сечова к-та|мочевая кислота|мочевая к-та|uric acid|urato|ουρικο", "bilirubin": "білірубін|билирубин|bilirrubina|bilirubin|χολερυθρ", "cholesterol": "холестерин|холестерол|colesterol|cholesterol|χοληστερ",
    "triglyceride": "тригліцерид|триглицерид|triglicérido|triglicerido|triglyceride|τριγλυκερ", "calcium": "кальцій|кальций|calcio|calcium|ασβεστιο", "phosphate": "фосфор|фосфат|fósforo|fosforo|fosfato|phosphate|phosphorus|φωσφορ",
    "magnesium": "магній|магний|magnesio|magnesium|μαγνησιο", "iron": "залізо|железо|hierro|iron|σιδηρο", "protein": "білок|белок|proteína|proteina|protein|πρωτεΐν|πρωτειν", "albumin": "альбумін|альбумин|albúmina|albumina|albumin|λευκωματ",
    "hemoglobin": "гемоглоб|hemoglobin|haemoglobin|hemoglobina|hgb|αιμοσφαιρ",
}
_OF_TEST = {address: a for a, addresses in TESTS.items() for address in addresses.split()}
_SPELLINGS = [(fold_text(s) or "", a) for s, a in spelled({a: names.split("|") for a, names in NAMES.items()}).items()]


def names_analyte(name: str | None, analyte: str) -> bool:
    """Whether the printed name says the substance itself, also with one letter of another alphabet."""
    folded = fold_text(name or "") or ""
    return any(s in folded for s, a in _SPELLINGS if a == analyte)


def analyte_of(test: str | None, name: str | None) -> str | None:
    """By the test's address; only where that says nothing (indicator, indicator-7), by the printed name."""
    address = (test or "").strip()
    if address in _OF_TEST:
        return _OF_TEST[address]
    stem, _, number = address.partition("-")
    if stem != "indicator" or number and not number.isdigit():
        return None
    return next((a for a in SCALES if names_analyte(name, a)), None)


def scale_and_factor(test: str | None, name: str | None, unit: str | None) -> dict | None:
    """analyte, scale and factor; None where the test has no scale, the name does not say the substance, or the
    unit is none of those that are known to be worth something on it."""
    analyte = analyte_of(test, name)
    if analyte is None or not names_analyte(name, analyte):
        return None
    scale, worth = SCALES[analyte]
    factor = worth.get(unit_key(unit) or "")
    return None if factor is None else {"analyte": analyte, "scale": scale, "factor": factor}


def converted(rows: DataFrame, test: str = "indicator_id", name: str = "name", unit: str = "unit", value: str = "value_numeric") -> DataFrame:
    """rows with to_analyte, to_scale, to_factor (null where a value stays as it is) and `converted`, the value
    on the scale.  Each different test, name and unit is read once."""
    out = on_distinct(rows, [test, name, unit], scale_and_factor, "analyte string, scale string, factor double", "to_")
    return out.withColumn("converted", out[value] * out["to_factor"])
