from datetime import date

import pytest

from folioscope.operators.rules import REGISTRY, run, tally, to_check

D = "document_id long, file_id string, date date, doc_type string, title string, provider string, institution_was string, transcribed boolean, due boolean, date_flags array<string>, page_dates array<date>, birth_dates array<date>, pages array<int>"
V = "observation_id long, document_id long, page int, name string, value string, value_numeric double, comparator string, value_kind string, value_role string, unit string, reference string, reference_low double, reference_high double, column_heading string, snippet string, indicator_id string, material string, date date"


def value(i, doc=1, page=1, name="glucose", value="5,1", number=5.1, comparator=None, kind="quantitative", role="result", unit="mmol/l", reference="3,9-6,1", low=3.9, high=6.1, heading=None, snippet=None, test="glucose", material="blood", day=date(2020, 1, 1)):
    return (i, doc, page, name, value, number, comparator, kind, role, unit, reference, low, high, heading, snippet or f"line {i}", test, material, day)


def tables(spark, values=(), documents=(), pages=(), unreadable=(), indicators=()):
    return {
        "values": spark.createDataFrame(list(values), V),
        "documents": spark.createDataFrame(list(documents), D),
        "pages": spark.createDataFrame(list(pages), "document_id long, page int, sent string, got string, as_text boolean, tabular boolean"),
        "unreadable": spark.createDataFrame(list(unreadable), "document_id long, page int"),
        "indicators": spark.createDataFrame(list(indicators), "indicator_id string, spelling string"),
    }


def document(i, file=None, day=date(2020, 1, 1), kind="lab_panel", title="Form", provider="City clinic", was=None, done=True, due=True, flags=(), dates=(), births=()):
    return (i, file or f"f{i}", day, kind, title, provider, was, done, due, list(flags), list(dates), list(births), [1])


def lines(spark, rule, **t):
    return sorted((r.document_id, r.line or r.page) for r in run(tables(spark, **t), only=[rule]).collect())


def test_registry():
    assert len(REGISTRY) == 42
    assert sum(r.step == "validate" for r in REGISTRY.values()) == 15 and sum(r.step == "suspects" for r in REGISTRY.values()) == 6


def test_value_rules(spark):
    v = [
        value(1), value(2, value="5,1", number=51.0), value(3, value="<5", number=5.0), value(4, value="5", number=5.0, comparator="<"), value(5, value="neg", number=None),
        value(6, reference="10-2", low=None, high=None), value(7, low=3.8), value(8, name="OD", snippet="OD sph -1,5 cyl 2"), value(9, value="sph 1 cyl 2", number=None), value(10, page=2, name="odd", role="other"),
        value(11, snippet="taken 01.02.2019 as told"), value(12, unit=None, reference="3,9-6,1 mmol/l"), value(13, unit="mg/dl"), value(14, value="5lO", number=5.0),
    ]
    find = lambda r, **k: [x[1] for x in lines(spark, r, values=v, **k)]
    assert find("number_differs") == ["line 2"]
    assert find("comparator_missing") == ["line 3", "line 4"] and find("comparator_not_printed") == ["line 4"]
    assert find("quantitative_without_number") == ["line 5"]
    assert find("reference_reversed") == ["line 6"] and find("range_read_two_ways") == ["line 7"]
    assert find("named_after_the_eye") == ["OD sph -1,5 cyl 2"] and find("several_measurements_in_one_value") == ["line 9"]
    assert find("row_without_result") == ["odd"]
    assert find("repeated_value") == ["glucose"] * 4  # five rows are equal
    assert find("value_quoted_from_another_study") == ["taken 01.02.2019 as told"]
    assert find("unit_from_range") == ["line 12"] and find("one_scale_for_a_test") == ["line 13"]
    images = [(1, 1, "", "", False, True)]
    assert find("letters_in_numeric_value_on_image", pages=images) == ["line 14", "line 5", "line 9"]


def test_archive_rules(spark):
    v = [value(k, value=str(x), number=x) for k, x in enumerate((79.0, 80.0, 78.0, 79.5, 800.0))]
    assert lines(spark, "number_far_from_the_others", values=v) == [(1, "line 4")]
    assert lines(spark, "number_far_from_the_others", values=v[2:]) == []
    units = [value(k) for k in range(10)] + [value(10, unit="mg/dl"), value(11, unit="ммоль/л"), value(12, unit=None)]
    assert lines(spark, "unit_alone_in_a_series", values=units) == [(1, "line 10")]
    assert lines(spark, "unit_missing_where_others_have_one", values=units) == [(1, "line 12")]
    assert lines(spark, "unit_by_numbers", values=units[:10] + [units[12]]) == [(1, "line 12")]
    ranges = [value(k, reference="4-6") for k in range(6)] + [value(6, reference="4000-6000")]
    assert lines(spark, "range_powers_from_the_rest", values=ranges) == [(1, "line 6")] == lines(spark, "two-scales-in-one-test", values=ranges)
    names = [value(1, value="see haemoglobin there"), value(2, value="haemoglobins")]
    assert lines(spark, "value_names_another_test", values=names, indicators=[("hb", "Haemoglobin"), ("glucose", "glucose x")]) == [(1, "line 1")]


def test_document_rules(spark):
    d = [document(1), document(2, title=None), document(3, was="Dr A. Petrov"), document(4, flags=["future"]), document(5, dates=[date(2020, 1, 1), date(2020, 4, 1)]), document(6, births=[date(2020, 1, 1)]), document(7, provider="Dr. House"), document(8, title="Cлово")]
    find = lambda r, **k: [x[0] for x in lines(spark, r, documents=d, **k)]
    assert find("lab_form_without_a_title") == [2] and find("institution_looks_like_a_name") == [3] and find("date_to_check") == [4]
    assert find("dates_far_apart") == [5] and find("document_date_is_birth_date") == [6] and find("provider_reads_like_a_person") == [7]
    assert find("word_in_two_alphabets") == [8]
    assert find("lab_without_values", values=[value(1, doc=k) for k in range(1, 8)]) == [8]
    assert find("unreadable_on_images", unreadable=[(1, 1), (2, 1)], pages=[(1, 1, "", "", False, False), (2, 1, "", "", True, False)]) == [1]
    assert find("unreadable_parts", unreadable=[(1, 1), (1, 2)]) == [1, 1]


@pytest.mark.parametrize(("a", "b", "fires"), [("abc", "abc", True), ("abcdefg", "abc", True), ("abcdefg", "ab", False), ("abcdefg", "abcdx", True), ("abcdefghi", "abcdx", False)])
def test_possible_copy(spark, a, b, fires):
    v = [value(k, doc=1, name=x) for k, x in enumerate(a)] + [value(100 + k, doc=2, name=x) for k, x in enumerate(b)]
    assert bool(lines(spark, "possible_copy", values=v, documents=[document(1), document(2)])) is fires
    assert lines(spark, "possible_copy", values=v, documents=[document(1, "f"), document(2, "f")]) == []


def test_page_rules(spark):
    long = " ".join(f"w{k}" for k in range(50))
    pages = [(1, 1, long, "short", True, True), (1, 2, "1 2 3 4 5 6 7 8 9 10 11", "1 2 3 4 and more text here", True, False), (1, 3, long + " 5,1", long, True, False), (1, 4, "", "page text of an image 7", False, False)]
    v = [value(1, page=2), value(2, page=3), value(3, page=4, value="8", reference="7-9"), value(4, page=3, value="9,9")]
    find = lambda r: [x[1] for x in lines(spark, r, pages=pages, values=v, documents=[document(1)])]
    assert find("page_text_missing") == [1] and find("page_text_short") == [1] and find("page_numbers_missing") == [1, 2]
    assert find("table_page_without_values") == [1]
    assert find("value_not_on_the_page") == ["line 4"] and find("value_not_in_page_text") == ["line 1", "line 2", "line 4"]
    assert find("value_not_in_own_page_text") == ["line 3"] and find("reference_not_in_own_page_text") == ["line 3"]
    assert find("reference_not_in_page_text") == ["line 1", "line 2", "line 4"]
    rows = [value(1, snippet="row"), value(2, snippet="row", value="6"), value(3, snippet="other"), value(4, snippet="h", heading="x"), value(5, snippet="h")]
    assert lines(spark, "no_column_headings_in_multi_value_rows", values=rows) == [(1, "row")]


def test_running(spark):
    t = tables(spark, values=[value(1), value(2, value="<5", number=5.0)], documents=[document(1, was="x", flags=["early"])])
    found = run(t)
    assert {r.rule: (r.findings, r.documents) for r in tally(found).collect()}["comparator_missing"] == (1, 1)
    assert "date_to_check" in to_check(found).first().codes
    assert run(t, switched={"date_to_check": False}).where("rule = 'date_to_check'").count() == 0
    with pytest.raises(KeyError):
        run(t, changed={"possible_copy": {"nonsense": 1}})
    with pytest.raises(KeyError):
        run(t, only=["nonsense"])
