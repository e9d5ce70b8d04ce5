from datetime import date

import pyspark.sql.functions as F
import pytest

from folioscope.functions.materials import is_derived, material_of, settled_material, specimen_word
from folioscope.operators.joins import replace_overlapping
from folioscope.operators.overlay import overlay_by_line
from folioscope.plans import people as P
from folioscope.plans import reading as R


def test_materials(spark):
    rows = [("Analysis of U R I N E", "protein", "", "", ""), (None, "blood sugar", None, "Blood test", None), (None, "hemoglobin", "in serum", None, None), (None, "x", None, None, "Загальний аналіз крові"), ("М О Ч А", "b", None, None, None)]
    frame = spark.createDataFrame(rows, "h string, n string, s string, t string, b string")
    got = [r[0] for r in frame.select(material_of(*map(F.col, "hnstb"))).collect()]
    assert got == ["urine", "blood", None, "blood", "urine"]
    frame = spark.createDataFrame([(None, None, "urine", "blood", False), (None, None, None, None, True), ("none said", None, "x", None, True), (None, None, None, None, False)], "p string, t string, w string, l string, n boolean")
    got = [tuple(r[0]) for r in frame.select(settled_material(*map(F.col, "ptwln"))).collect()]
    assert got == [("urine", "printed"), (None, "no sample"), ("none said", "person"), (None, "unknown")]
    frame = spark.createDataFrame([("eGFR", None, None), ("creatinine", "ml/min/1,73 m2", None), ("creatinine", "umol/l", "Results")], "n string, u string, h string")
    assert [r[0] for r in frame.select(is_derived(*map(F.col, "nuh"))).collect()] == [True, True, False]
    assert spark.createDataFrame([("Urine",), ("Urine protein",)], "n string").select(specimen_word(F.col("n"))).collect() == [(True,), (False,)]


def test_names(spark):
    frame = spark.createDataFrame([("Dr. House", None), ("City Hospital of Dr. House", "x"), ("Петров А. Б.", "y")], "provider string, doctor string")
    got = [tuple(r) for r in P.institution_and_doctor(frame).select("provider", "doctor", "institution_was").collect()]
    assert got == [(None, "Dr. House", "Dr. House"), ("City Hospital of Dr. House", "x", None), (None, "y", "Петров А. Б.")]
    names = spark.createDataFrame([(n,) for n in ["North Lab", "north  lab", "North Lab Centre", "Lab Centre", "South Lab", "Lab"]], "name string")
    pairs = P.worth_joining(names)
    assert {(r.a, r.b) for r in pairs.collect()} == {("North Lab", "north  lab"), ("North Lab", "North Lab Centre"), ("north  lab", "North Lab Centre"), ("Lab Centre", "North Lab Centre")}
    assert {r.name: r.family for r in P.families(pairs).collect()}["North Lab Centre"] == "North Lab"
    tails = P.worth_joining(spark.createDataFrame([("A B Smith",), ("B Smith",), ("A B",)], "name string"), suffix_only=True)
    assert [tuple(r) for r in tails.collect()] == [("B Smith", "A B Smith")]
    text = "Doctor: Smith J. (chief)\nreferred by Dr. Brown K.\nЛікар Коваль О.П.\nnothing"
    found = P.doctors_in_text(spark.createDataFrame([(1, text), (2, "dr Smith J.")], "document_id long, text string"))
    assert {(r.name, r.documents) for r in P.who_stands_in_the_text(found).collect()} == {("Smith J.", 2), ("Коваль О.П.", 1)}


def test_person(spark):
    frame = spark.createDataFrame([("A(II) Rh+",), ("группа III, резус отрицательный",), ("0 (I) pos",), ("?",)], "t string")
    assert [tuple(r) for r in frame.select(P.blood_group(F.col("t")), P.rhesus(F.col("t"))).collect()] == [("A", "+"), ("B", "-"), ("O", "+"), (None, None)]
    rows = [("group", "A", 1, date(2020, 1, 1)), ("group", "A", 2, date(2021, 1, 1)), ("group", "B", 3, None), ("sex", "f", 4, None)]
    got = {(r.fact, r.answer): (r.document_id, r.answers) for r in P.facts(spark.createDataFrame(rows, "fact string, answer string, document_id long, date date")).collect()}
    assert got == {("group", "A"): (2, 2), ("group", "B"): (3, 2), ("sex", "f"): (4, 1)}
    rolled = P.roll(spark.createDataFrame([("d", 1, None), ("d", 2, date(2020, 1, 1)), ("e", 3, None)], "t string, document_id long, date date"), "t")
    assert {r.text: (r.times, r.newest_document) for r in rolled.collect()} == {"d": (2, 2), "e": (1, 3)}


def test_dates(spark):
    schema = "document_id long, person date, study date, report date, page_date date, second_look date, birth_dates array<date>, printed string, ambiguous boolean"
    d = lambda y: date(y, 1, 1)
    rows = [(1, None, d(2020), d(2021), None, None, [], "x", False), (2, d(2019), d(2020), None, None, None, [], "x", True), (3, None, d(1980), None, d(2020), None, [d(1980)], "x", False), (4, None, None, None, None, d(2030), None, "x", None), (5, None, None, None, None, None, None, "?", None)]
    got = {r.document_id: (r.date_source, r.date_flags) for r in R.document_dates(spark.createDataFrame(rows, schema), F.lit("2026-01-01").cast("date")).collect()}
    assert got == {1: ("study", ["apart"]), 2: ("person", []), 3: ("page_date", ["birth_date"]), 4: ("second_look", ["future", "second_look"]), 5: (None, ["not_read"])}
    rows = [(1, "p", "13/02/2020"), (2, "p", "01/02/2020"), (3, "q", "02/14/2020"), (4, None, "01.02.2020")]
    got = {r.document_id: r.day_first for r in R.day_first_evidence(spark.createDataFrame(rows, "document_id long, provider string, printed string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: None}


def test_reading(spark):
    pages = spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 1, 1), ("b", 1, 5, 0), ("c", 1, 999, 1)], "file string, page int, lines int, unreadable int")
    assert {r.file: r.percent for r in R.file_reading(pages).collect()} == {"a": 75, "b": 100, "c": 99}
    runs = spark.createDataFrame([(100, 10, 100 * 15.0 + 10 * 127.0), (50, 60, 50 * 15.0 + 60 * 127.0)], "text_pages int, image_pages int, seconds double")
    assert R.reading_prices(runs).first() == (pytest.approx(15.0), pytest.approx(127.0))
    assert R.reading_prices(runs.limit(1)).first() == (None, None)
    c = spark.createDataFrame([("text", "lab_panel", None, 0.7, True, None), ("vision", "other", "en", 0.99, False, None)], "route string, doc_type string, language string, confidence double, legible boolean, error string")
    assert [r[0] for r in c.select(R.classification_problems()).collect()] == [["low_confidence"], ["not_legible", "type_other"]]
    assert [r[0] for r in c.select(R.goes_to_extract()).collect()] == [True, False]
    assert ("language", "not said", 1) in [tuple(r) for r in R.classify_summary(c).collect()]
    f = spark.createDataFrame([("a",), ("b",)], "file string")
    done = R.coverage(f, pages, pages.select(F.lit(1).alias("document_id")), pages.where("page = 1"), pages.limit(0).select(F.lit(1).alias("document_id")))
    assert [tuple(r) for r in done.collect()] == [("files", 0), ("pages", 1), ("documents", 4)]


def test_overlays(spark):
    lines = spark.createDataFrame([("d", "k1", "s", "1"), ("d", "k2", "s", "2"), ("d", "k3", "t", "3"), ("d", "k4", "u", "4")], "document string, key string, short_key string, value string")
    edits = spark.createDataFrame([(1, "d", "s", "x"), (2, "d", "t", "y"), (3, "d", "t", "z"), (4, "d", "k4", "w"), (5, "d", "u", "v")], "seq long, document string, edit_key string, value string")
    assert {r.key: (r.value, r.corrected) for r in overlay_by_line(lines, edits).collect()} == {"k1": ("1", False), "k2": ("2", False), "k3": ("z", True), "k4": ("w", True)}
    kept = spark.createDataFrame([("f", [1, 2], "old"), ("f", [3], "stays"), ("g", [1], "other")], "file string, pages array<int>, v string")
    new = spark.createDataFrame([("f", [2, 4], "new")], "file string, pages array<int>, v string")
    assert {r.v for r in replace_overlapping(kept, new, ["file"]).collect()} == {"new", "stays", "other"}
