"""Steps whose small sides are staged: no row is shuffled to meet them."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from folioscope.functions import numbers as N
from folioscope.functions.parsing import on_distinct, read_range
from folioscope.operators.rules import run, tally
from folioscope.plans.series import charts
from folioscope.session import staged


def shuffles(frame) -> int:
    """Shuffles by key in the plan of a frame, apart from what is staged already."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_staged_keeps_rows_and_types(spark):
    frame = spark.createDataFrame([(1, None, [1.5]), (2, "b", None)], "id long, s string, a array<double>").withColumn("nothing", F.lit(None))
    out = staged(frame)
    assert out.dtypes == frame.dtypes and out.orderBy("id").collect() == frame.orderBy("id").collect()
    assert staged(frame.where("false")).collect() == []


def test_parsed_answers_are_met_without_a_shuffle(spark):
    frame = spark.createDataFrame([(k, None if k % 3 == 0 else f"{k % 3}-5") for k in range(50)], "id long, t string")
    out = on_distinct(frame, ["t"], read_range, "low double, high double")
    assert shuffles(out) == 0
    assert {(r.id, r.low, r.high) for r in out.collect()} == {(k, *((None, None) if k % 3 == 0 else (float(k % 3), 5.0))) for k in range(50)}


def test_values_of_a_chart_are_shuffled_once(spark):
    """By day, to be numbered; and columns that nobody wants any more are left behind."""
    rows = [
        (k, k % 40, f"t{k % 2}", None if k % 5 else "blood", "ring", "5", float(k % 7), [None, "g/l", "mmol/l"][k % 3], "10-40 g/l" if k % 4 else None, date(2020, 1, 1) + timedelta(k % 30), "a line")
        for k in range(200)
    ]
    frame = spark.createDataFrame(rows, "observation_id long, document_id long, indicator_id string, material string, name string, value string, value_numeric double, unit string, reference string, date date, snippet string")
    out = charts(frame, without=("name", "snippet"))
    assert shuffles(out) == 1 and "name" not in out.columns and "reference" in out.columns
    assert out.count() == 200 and out.select("indicator_id", "material", "series", "place").distinct().count() == 200
    whole = charts(frame)
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.select(*out.columns).collect()))


def test_retellings_go_with_either_side_larger(spark):
    """A value told in another line, with its day, meets the measured one nearest to it, before or after."""
    day = date(2020, 6, 1)
    measured = [(k, k, "t", "blood", "ring", "5", float(k), "g/l", None, day + timedelta(k), "a line") for k in range(1, 60)]
    told = [(100 + k, k, "t", "blood", "ring", "5", float(k), "g/l", None, date(2021, 6, 1), f"a line of {(day + timedelta(k + shift)).isoformat()}") for k, shift in ((3, 40), (9, -45), (20, 46))]
    frame = spark.createDataFrame([*measured, *told], "observation_id long, document_id long, indicator_id string, material string, name string, value string, value_numeric double, unit string, reference string, date date, snippet string")
    by = {r.observation_id: r for r in charts(frame).collect()}
    assert len(by) == 60 and 120 in by and by[120].quoted
    assert {k for k, r in by.items() if r.retold} == {3, 9} and by[3].retold == 1


VALUES = "document_id long, page int, name string, value string, value_numeric double, comparator string, value_role string, unit string, reference string, reference_low double, reference_high double, column_heading string, snippet string"


def test_rules_of_rows_shuffle_nothing_and_rules_of_groups_once(spark):
    rows = [(k // 9, k % 2, f"n{k % 4}", f"{k % 3},5", k % 3 + 0.5 + k % 2, None, ["result", "other"][k % 2], [None, "g/l"][k % 2], ["5-3", "3-5 g/l", None][k % 3], 3.0, 6.0, None, "a line") for k in range(90)]
    values = spark.createDataFrame(rows, VALUES)
    of_rows = run({"values": values}, only=["number_differs", "comparator_missing", "reference_reversed", "range_read_two_ways"])
    assert shuffles(of_rows) == 0
    assert {(r.rule, r.findings) for r in tally(of_rows).collect()} == {("number_differs", 45), ("reference_reversed", 30), ("range_read_two_ways", 30)}
    of_groups = run({"values": values}, only=["row_without_result", "repeated_value"])
    assert shuffles(of_groups) == 2
    seen = [(r[0], r[1], r[2], r[3], r[7]) for r in rows]
    alone = {(r[0], r[1], r[2]) for r in rows} - {(r[0], r[1], r[2]) for r in rows if r[6] == "result"}
    got = {r.rule: r.findings for r in tally(of_groups).collect()}
    assert got == {k: n for k, n in (("row_without_result", len(alone)), ("repeated_value", len(seen) - len(set(seen)))) if n} and got


def test_a_number_alone_is_read_like_one_among_others(spark):
    texts = ["5", " < 5,0 ", ">=5", "≤ 5.00", "5.000", "1 234", "l5", "5 mg", "5,5,5", "005", ".5", "5.", "<<5", "", "neg", None, "9" * 400, "٥"]
    frame = spark.createDataFrame([(t, v) for t in texts for v in (5.0, 5000.0, 0.5, 1234.0, None)], "t string, v double")
    full = N._one_is(N.number_tokens(F.col("t")), F.col("v"))
    some = F.size(N.number_tokens(F.coalesce("t", F.lit("")))) > 0
    got = frame.select("t", "v", N.number_matches(F.col("t"), F.col("v")).alias("m"), full.alias("full"), N.number_differs(F.col("t"), F.col("v")).alias("d"), some.alias("some")).collect()
    for r in got:
        assert bool(r.m) == bool(r.full), r
        assert r.v is None or bool(r.d) == (r.some and not r.full), r
    assert {r.t for r in got if r.m and r.v == 5.0} == {"5", " < 5,0 ", ">=5", "≤ 5.00", "5.000", "5 mg", "005", "5.", "<<5"}
