from datetime import date

import pyspark.sql.functions as F
import pytest

from folioscope.functions import numbers as N
from folioscope.functions.parsing import on_distinct, outside, power_of, printed_ends, read_date, read_range, to_mmol, unit_key
from folioscope.functions.text import also_written_as, fold, fold_exact, fold_text, mixed_script_words, snippet, stems, text_pages, unspaced

TODAY = date(2026, 5, 1)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("3,89-5,84", (3.89, 5.84)), ("53-115 мкмоль/л", (53, 115)), ("< 46 Е/л", (None, 46)), ("до 90 Е/л", (None, 90)), ("> 1,7 ммоль/л", (1.7, None)),
        ("от 1,2", (1.2, None)), ("до 150 мг/24 ч", (None, 150)), ("1:40", None), ("10-2", None), ("М <5 Ж <7", None), ("ч - 24-195; ж - 24-170", None),
        ("negative", None), (None, None), ("", None),
    ],
)
def test_ranges(text, want):
    got = read_range(text)
    assert (got and (got["low"], got["high"])) == want
    assert printed_ends("10-2") == {"low": 10.0, "high": 2.0, "two_ways": False}


def test_outside(spark):
    rows = [(6.9, 3.89, 5.84, None), (4.2, 3.89, 5.84, None), (7.0, None, None, None), (None, 1.0, 2.0, None), (0.5, 0.5, 1.0, "<"), (3.0, None, 5.0, "<"), (3.0, 1.0, 5.0, "<"), (9.0, None, 5.0, ">")]
    frame = spark.createDataFrame(rows, "v double, lo double, hi double, c string")
    got = [r[0] for r in frame.select(outside(F.col("v"), F.col("lo"), F.col("hi"), F.col("c"))).collect()]
    assert got == [True, False, None, None, True, False, None, True]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("03/02/2026 11:37:48", ("2026-02-03", "day", True)), ("13/02/2026", ("2026-02-13", "day", False)), ("02/13/2026", ("2026-02-13", "day", False)),
        ("12 березня 2019 р.", ("2019-03-12", "day", False)), ("3 de febrero de 2026", ("2026-02-03", "day", False)), ("12.III.03", ("2003-03-12", "day", False)),
        ("5/ХІ 2001", ("2001-11-05", "day", False)), ("17.05.92", ("1992-05-17", "day", False)), ("март 2005", ("2005-03-01", "month", False)),
        ("08. 89", ("1989-08-01", "month", False)), ("2007 г.", ("2007-01-01", "year", False)), ("12.03", None), ("", None), (None, None),
    ],
)
def test_dates(text, want):
    got = read_date(text, TODAY)
    assert (got and (got["value"].isoformat(), got["precision"], got["ambiguous"])) == want


def test_units():
    same = [("Од/л", "U/L"), ("МЕ/л", "IU/L"), ("нмоль/л", "nmol/L"), ("мкмоль/л", "µmol/L"), ("мм/год", "mm/h"), ("мл/хв/1,73 м²", "ml/min/1.73 m2"), ("10^9/л", "×10⁹/л")]
    for a, b in same:
        assert unit_key(a) == unit_key(b)
    for group in (["мг/л", "г/л", "мкг/л"], ["ммоль/л", "мкмоль/л", "нмоль/л"]):
        assert len({unit_key(u) for u in group}) == 3
    assert unit_key(" ") is None and power_of("10^9/l") == 9 and power_of("/ul") == 6 and power_of("g/l") is None
    assert to_mmol("glucose", "mg/dl")["factor"] == pytest.approx(1 / 18.016, rel=1e-4)
    assert to_mmol("ferritin", "mg/dl") is None


def test_numbers(spark):
    texts = {"4,5": [4.5], "1.234": [1.234, 1234.0], "1 234": [1234.0], "1.234,56": [1234.56], "1,234.56": [1234.56], "0,033": [0.033], ".5": [0.5], "x": [], None: None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", N.readings(F.col("t")).alias("r"), N.number(F.col("t")).alias("n")).collect()
    assert {r.t: r.r or ([] if r.t else None) for r in rows} == {k: v for k, v in texts.items()}
    assert {r.t: r.n for r in rows}["1 234"] == 1234.0 and {r.t: r.n for r in rows}["x"] is None
    frame = spark.createDataFrame([("< 1.234", 1234.0, 100.0, 2000.0), ("5 or 6", 6.0, None, None), ("1,5e3 abc", 7.0, None, None)], "t string, v double, lo double, hi double")
    got = frame.select(
        N.number_matches(F.col("t"), F.col("v")), N.number_as_printed(F.col("t"), F.col("lo"), F.col("hi")), N.comparator_printed(F.col("t")),
        N.reads_at_two_scales(F.col("t")), N.unexplained_letters(F.col("t")),
    ).collect()
    assert tuple(got[0]) == (True, 1234.0, "<", True, False)
    assert got[1][0] and got[1][1] is None and got[1][4] and not got[2][0]


FOLDS = [("Гемоглобін", "Гемоглобин"), ("ΑΙΜΑΤΟΛΟΓΙΚΟΣ", "αιματολογικός"), ("п’ять", "пять"), ("день", "ден"), ("straße", "strasse"), ("Ёлка ъ", "елка "), ("CAFÉ", "café")]


def test_fold(spark):
    frame = spark.createDataFrame([(x,) for pair in FOLDS for x in pair] + [(None,)], "t string")
    rows = frame.select("t", fold(F.col("t")).alias("native"), fold_exact("t").alias("exact")).collect()
    for r in rows:
        assert r.exact == fold_text(r.t) and (r.native == r.exact)
    for a, b in FOLDS:
        assert fold_text(a) == fold_text(b)


def test_text(spark):
    assert also_written_as("b12") == ["b12", "в12", "β12"] and also_written_as("glucose") == ["glucose"]
    frame = spark.createDataFrame([("U R I N E test", "a" * 300 + " needle " + "b" * 300, "аbc abc абв")], "a string, b string, c string")
    r = frame.select(
        unspaced(F.col("a")), snippet(F.col("b"), F.col("b"), ["needle"]), mixed_script_words(F.col("c")), stems(F.lit("glucose in blood glucosa")), text_pages(F.lit("x" * 7 + "\nyy\n"), 5)
    ).first()
    assert r[0] == "URINE test" and "needle" in r[1] and len(r[1]) == 240 and r[2] == ["аbc"] and r[3] == ["gluco", "blood"] and "".join(r[4]).replace("\n", "") == "x" * 7 + "yy"


def test_on_distinct(spark):
    frame = spark.createDataFrame([(1, "3-5"), (2, "3-5"), (3, None), (4, "word")], "id long, t string")
    got = {r.id: (r.low, r.high) for r in on_distinct(frame, ["t"], read_range, "low double, high double").collect()}
    assert got == {1: (3.0, 5.0), 2: (3.0, 5.0), 3: (None, None), 4: (None, None)}
    when = on_distinct(frame.select("id", F.lit("12.03.2020").alias("t")), ["t"], lambda t: read_date(t, TODAY), "value date, precision string, ambiguous boolean")
    assert when.first().value == date(2020, 3, 12)
