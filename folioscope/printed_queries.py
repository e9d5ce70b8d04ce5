"""Queries over what forms print (ranges, dates, spellings, names) and over what is kept of it.  Every row prints
its own numbers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions.analytes import converted
from .functions.dates import read_date
from .functions.eyes import measurements_named, the_eye_alone
from .functions.parsing import on_distinct
from .functions.ranges import outside, read_range
from .functions.slips import read_spellings, with_slips
from .operators import overlay, rules, snapshots
from .plans import people, reading, series, vocabulary
from .plans.bindings import bound, table
from .queries import _DUCK_VALUES, PAPERS, SHEETS, VALUES, query


def _concat(template: str) -> str:
    """A form as SQL: {x} is a column."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return "concat(" + ", ".join(f"CAST({p[1:-1]} AS STRING)" if p[0] == "{" else "'" + p.replace("'", "''") + "'" for p in parts) + ")"


def _case(by: str, values: list[str]) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


# Forms of a range, the ends that each has, and what unit the value beside it is in.
RANGE_FORMS = [
    ("{a}-{b}", "a", "b", "NULL"), ("{a},5 – {b},5 ммоль/л", "a + 0.5", "b + 0.5", "NULL"), ("от {a} до {b}", "a", "b", "NULL"), ("{a}.25 to {b}.75", "a + 0.25", "b + 0.75", "NULL"),
    ("{a},0 a {b},0", "a", "b", "NULL"), ("{a} έως {b} g/L", "a", "b", "NULL"), ("Ref: {a}.0-{b}.0", "a", "b", "NULL"), ("х10⁹/л {a},0-{b},0", "a", "b", "NULL"), ("Норма до: {b}", "NULL", "b", "NULL"),
    ("{b} и менее", "NULL", "b", "NULL"), ("{b} and below", "NULL", "b", "NULL"), ("не менее {a}", "a", "NULL", "NULL"), ("не более {b} мг/24 ч", "NULL", "b", "NULL"), ("menor o igual a {b}", "NULL", "b", "NULL"),
    ("≤{b} від верхньої межі", "NULL", "b", "NULL"), ("{a} ή περισσότερο", "a", "NULL", "NULL"), ("{a} - {b} > 15 ετών", "a", "b", "NULL"), ("{a} – {b} % {c} – {d}*10⁹/л", "c", "d", "'10^9/л'"),
    ("{a} – {b} % {c} – {d}*10⁹/л", "a", "b", "'%'"), ("{a}.000 - {b}.000", "a", "b", "NULL"), ("{a} 000 - {b} 000", "a * 1000", "b * 1000", "NULL"),
    ("≤{b}% від білірубіну", "NULL", "NULL", "NULL"), ("1:{b}", "NULL", "NULL", "NULL"), ("М <{a} Ж <{b}", "NULL", "NULL", "NULL"), ("< {a} Normal, {a} - {b} High", "NULL", "NULL", "NULL"),
    ("М {a} – {b} Ж {c} – {d} г/л", "NULL", "NULL", "NULL"), ("{b}-{a}", "NULL", "NULL", "NULL"), ("{a}-{b}-{c}", "NULL", "NULL", "NULL"), ("{a} – {b} % {c} – {d}*10⁹/л", "NULL", "NULL", "NULL"), ("negative", "NULL", "NULL", "NULL"),
]
_N = len(RANGE_FORMS)
_ENDS = "SELECT l_suppkey % {n} AS form, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + l_linenumber AS b, CAST(l_quantity AS INT) + 60 AS c, CAST(l_quantity AS INT) + 90 AS d, l_quantity + l_partkey % 9 - 2 AS value FROM lineitem"
RANGED = f"SELECT form, a, b, c, d, value, {_case('form', [_concat(f[0]) for f in RANGE_FORMS])} AS reference, {_case('form', [f[3] for f in RANGE_FORMS])} AS unit FROM (" + _ENDS.format(n=_N) + ") AS e"


@query(f"""WITH e AS ({_ENDS.format(n=_N)}), r AS (SELECT form, value, {_case('form', [f'CAST({f[1]} AS DOUBLE)' for f in RANGE_FORMS])} AS low, {_case('form', [f'CAST({f[2]} AS DOUBLE)' for f in RANGE_FORMS])} AS high FROM e)
  SELECT form, CASE WHEN low IS NULL AND high IS NULL THEN NULL ELSE coalesce(value < low, FALSE) OR coalesce(value > high, FALSE) END AS outside, count(*) AS "values", round(sum(low), 3) AS low, round(sum(high), 3) AS high FROM r GROUP BY 1, 2""")
def ranges_read(spark, sf_dir):
    """Ranges in words, behind the number, by unit, and what is no range; and which values lie outside."""
    rows = bound(spark, sf_dir, RANGED, "lineitem")
    read = on_distinct(rows, ["reference", "unit"], read_range, "low double, high double, two_ways boolean", "r_")
    out = outside(F.col("value").cast("double"), F.col("r_low"), F.col("r_high"), None, F.col("r_two_ways"))
    return read.groupBy("form", out.alias("outside")).agg(F.count(F.lit(1)).alias("values"), F.round(F.sum("r_low"), 3).alias("low"), F.round(F.sum("r_high"), 3).alias("high"))


# Months as forms decline them, in order.
UKRAINIAN = "січня,лютого,березня,квітня,травня,червня,липня,серпня,вересня,жовтня,листопада,грудня"
RUSSIAN = "января,февраля,марта,апреля,мая,июня,июля,августа,сентября,октября,ноября,декабря"
SPANISH = "enero,febrero,marzo,abril,mayo,junio,julio,agosto,septiembre,octubre,noviembre,diciembre"
ENGLISH = "January,February,March,April,May,June,July,August,September,October,November,December"
GREEK = "Ιανουαρίου,Φεβρουαρίου,Μαρτίου,Απριλίου,Μαΐου,Ιουνίου,Ιουλίου,Αυγούστου,Σεπτεμβρίου,Οκτωβρίου,Νοεμβρίου,Δεκεμβρίου"
ROMAN = "I,II,III,IV,V,VI,VII,VIII,IX,X,XI,XII"
_NAMES = ", ".join(f"split_part('{names}', ',', month(day)) AS {k}" for k, names in {"uk": UKRAINIAN, "ru": RUSSIAN, "es": SPANISH, "en": ENGLISH, "el": GREEK, "ro": ROMAN}.items())
_PIECES = f"day(day) AS d, lpad(CAST(day(day) AS STRING), 2, '0') AS dd, lpad(CAST(month(day) AS STRING), 2, '0') AS mm, year(day) AS y, lpad(CAST(year(day) % 100 AS STRING), 2, '0') AS yy, {_NAMES}"
# Forms of a date, and how finely each is printed.
DATE_FORMS = [
    ("{dd}.{mm}.{y}", "day"), ("ТТГ 4.12 від {d} {uk} {y} р.", "day"), ("TSH 4,12 de {d} de {es} de {y}", "day"), ("ΤΣΗ 4.12 στις {d} {el} {y}", "day"), ("TSH 4.12 from {en} {d}, {y}", "day"),
    ("«{d}» {ru} {y}г.", "day"), ("{dd}-{en}-{y}", "day"), ("{d}.{ro}.{yy}", "day"), ("{d}/{ro}-{yy}г.", "day"), ("08:30 {dd}.{mm}.{y}", "day"), ("{y}-{mm}-{dd} 11:37", "day"), ("№ 4517 {d} {mm} {y}", "day"),
    ("Стр. 1 из 2 {dd}.{mm}.{yy}", "day"), ("{uk} {y}", "month"), ("{es} de {y}", "month"), ("від {mm}.{y}", "month"), ("{y} г.", "year"), ("{dd}.{mm}-{y}", "year"), ("без даты", "none"),
]
DATED = f"SELECT o_orderkey, form, {_case('form', [_concat(f[0]) for f in DATE_FORMS])} AS printed FROM (SELECT o_orderkey, o_custkey % {len(DATE_FORMS)} AS form, {_PIECES} FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders) AS o) AS p"


@query(f"""WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {_case(f'o_custkey % {len(DATE_FORMS)}', [f"'{f[1]}'" for f in DATE_FORMS])} AS how FROM orders)
  SELECT o_orderkey, CASE how WHEN 'none' THEN NULL ELSE CAST(date_trunc(how, day) AS DATE) END AS value, CASE WHEN how <> 'none' THEN how END AS precision FROM f""")
def dates_read(spark, sf_dir):
    """Dates in five languages, behind numbers and prepositions; the century of short years is told by a day given."""
    from datetime import date

    rows = bound(spark, sf_dir, DATED, "orders")
    read = on_distinct(rows, ["printed"], lambda t: read_date(t, date(2026, 1, 1)), "value date, precision string", "r_")
    return read.select("o_orderkey", F.col("r_value").alias("value"), F.col("r_precision").alias("precision"))


# Lines that retell a study of another day, and lines whose numbers are no dates.
LINES = [
    ("ТТГ 3.47 від {dd}.{mm}.{yy} р.", "day"), ("PSA ({dd}.{mm}.{y}) 6,21 ng/ml", "day"), ("ТТГ 4.12 від {d} {uk} {y} р.", "day"), ("TSH 4,12 de {d} de {es} de {y}", "day"), ("ΤΣΗ 4.12 στις {d} {el} {y}", "day"),
    ("TSH 4.12, {dd}-{en}-{y}", "day"), ("ТТГ 4.12 з {d}.{ro}.{y}", "day"), ("ПСА-4,18 нг/мл ({mm}.{y}: Lab)", "month"), ("УЗО від {mm}.{y} - простата 31см3", "month"), ("ТТГ 4.12 ({uk} {y})", "month"),
    ("Глюкоза 5.31 4.10-5.{dd} ммоль/л", "none"), ("Феритин 23 нг/мл (норма 4-{y})", "none"), ("Коефіцієнт {mm}.{y} умовних", "none"), ("по 1 таблетці на день 5-7-{dd} днів", "none"), ("Vis 6/9/{yy}", "none"),
    ("версія v{d}.{mm}.{yy}", "none"), ("Феритин 23 нг/мл march {y}", "none"), ("щось {dd}.{mm}-{y} щось", "none"), ("WBC {d}.9 x 10 9/L", "none"), ("Лейкоцити {d} х 10 9/л", "none"),
]
_M = len(LINES)
_RETOLD = "SELECT l_orderkey, l_linenumber, l_partkey % {n} AS form, CAST(l_shipdate AS DATE) AS date, {earlier} AS day FROM lineitem"
_SPARK_DAY, _DUCK_DAY = "date_add(CAST(l_shipdate AS DATE), -CAST(l_quantity AS INT) * 5)", "CAST(l_shipdate AS DATE) - CAST(l_quantity AS INT) * 5"
RETELLING = f"SELECT l_orderkey, l_linenumber, date, {_case('form', [_concat(f[0]) for f in LINES])} AS snippet FROM (SELECT l_orderkey, l_linenumber, form, date, {_PIECES} FROM (" + _RETOLD.format(n=_M, earlier=_SPARK_DAY) + ") AS r) AS p"


@query(f"""WITH r AS ({_RETOLD.format(n=_M, earlier=_DUCK_DAY)}), h AS (SELECT *, {_case('form', [f"'{f[1]}'" for f in LINES])} AS how FROM r),
  q AS (SELECT *, CASE how WHEN 'none' THEN NULL ELSE CAST(date_trunc(how, day) AS DATE) END AS said FROM h)
  SELECT l_orderkey, l_linenumber, coalesce(said IS NOT NULL AND date - said > 31, FALSE) AS quoted, CASE WHEN date - said > 31 THEN said ELSE date END AS date FROM q""")
def values_redated(spark, sf_dir):
    """Values whose own line names the day of an earlier study move to it; ranges, doses and formulas move nothing."""
    rows = bound(spark, sf_dir, RETELLING, "lineitem")
    return series.with_quoted_dates(rows).select("l_orderkey", "l_linenumber", "quoted", "date")


SLIPPED = """
SELECT p_partkey, split_part(p_name, ' ', 2) AS word, 1 + p_partkey % length(split_part(p_name, ' ', 2)) AS place FROM part
"""


@query(f"""WITH s AS ({SLIPPED}), k AS (SELECT *, substr(word, place, 1) AS letter FROM s), t AS (SELECT *, translate(letter, 'abcehikmoptxy', 'авсенікморτху') AS twin FROM k)
  SELECT p_partkey, word AS indicator_id, letter <> twin AS slipped FROM t""")
def slipped_spellings(spark, sf_dir):
    """Names of which one letter is typed in another alphabet, by a table of slips that no two names share."""
    rows = bound(spark, sf_dir, SLIPPED, "part")
    letter = F.substr("word", F.col("place"), F.lit(1))
    twin = F.translate(letter, "abcehikmoptxy", "авсенікморτху")
    printed = F.concat(F.substr("word", F.lit(1), F.col("place") - 1), twin, F.substr("word", F.col("place") + 1))
    vocabulary = rows.select(F.col("word").alias("meaning"), "word")
    read = read_spellings(rows.select("p_partkey", F.upper(printed).alias("printed")), "printed", with_slips(vocabulary, "meaning", "word"))
    return read.select("p_partkey", F.col("meaning").alias("indicator_id"), "slipped")


# ---------------------------------------------------------------- what other thresholds would find, and what is open

# Rules, and the thresholds that are tried.
TRIED = {"number_far_from_the_others": [1.5, 2, 3, 5, 10, 50], "unit_missing_where_others_have_one": [1, 4, 10, 100], "page_text_missing": [5, 15, 20, 60], "page_text_short": [0.1, 0.5, 0.9], "value_quoted_from_another_study": [10, 20, 31, 45], "dates_far_apart": [0, 30, 60]}
_TRIED = ", ".join(f"('{r}', {float(v)}::DOUBLE)" for r, values in TRIED.items() for v in values)


@query(f"""WITH v AS ({_DUCK_VALUES}), d AS ({PAPERS}), p AS ({SHEETS}), t(rule, threshold) AS (VALUES {_TRIED}),
  positive AS (SELECT * FROM v WHERE value_role = 'result' AND value_numeric > 0),
  med AS (SELECT indicator_id AS i, coalesce(unit, '') AS u, coalesce(material, '') AS m, median(value_numeric) AS middle, count(*) AS n FROM positive GROUP BY 1, 2, 3),
  habit AS (SELECT indicator_id AS i, count(*) AS n FROM v WHERE unit IS NOT NULL AND value_numeric IS NOT NULL GROUP BY 1),
  w AS (SELECT document_id, len(regexp_extract_all(sent, '[a-z0-9]+')) AS sent, len(regexp_extract_all(got, '[a-z0-9]+')) AS got FROM p),
  m AS (SELECT 'number_far_from_the_others' AS rule, document_id, greatest(value_numeric / middle, middle / value_numeric) AS x FROM positive JOIN med ON indicator_id = i AND coalesce(unit, '') = u AND coalesce(material, '') = m WHERE n >= 4
   UNION ALL SELECT 'unit_missing_where_others_have_one', document_id, n FROM v JOIN habit ON indicator_id = i WHERE unit IS NULL AND value_numeric IS NOT NULL
   UNION ALL SELECT 'page_text_missing', document_id, -length(trim(got)) FROM p UNION ALL SELECT 'page_text_short', document_id, -got / sent FROM w WHERE sent > 40
   UNION ALL SELECT 'value_quoted_from_another_study', document_id, date - CAST(right(snippet, 10) AS DATE) FROM v WHERE snippet LIKE 'seen on %' AND date - CAST(right(snippet, 10) AS DATE) > 0
   UNION ALL SELECT 'dates_far_apart', document_id, CASE WHEN document_id % 3 = 0 THEN document_id % 90 ELSE 0 END FROM d)
  SELECT t.rule, threshold, count(document_id) AS findings, count(DISTINCT document_id) AS documents FROM t LEFT JOIN m ON t.rule = m.rule
    AND CASE WHEN t.rule LIKE 'page_text%' THEN -x < threshold WHEN t.rule = 'dates_far_apart' THEN x > threshold ELSE x >= threshold END GROUP BY 1, 2""")
def rule_trial(spark, sf_dir):
    """What each of six rules would find at each of several thresholds; one pass a rule."""
    documents = bound(spark, sf_dir, PAPERS, "orders").withColumn("page_dates", F.array("date", F.when(F.col("document_id") % 3 == 0, F.date_add("date", (F.col("document_id") % 90).cast("int"))).otherwise(F.col("date"))))
    tables = {"values": bound(spark, sf_dir, VALUES, "lineitem", "part"), "documents": documents, "pages": bound(spark, sf_dir, SHEETS, "lineitem")}
    tried = [rules.trial(tables, name, values) for name, values in TRIED.items()]
    out = tried[0]
    for more in tried[1:]:
        out = out.unionByName(more)
    return out


# Findings by the kinds of events, and which of them are settled.
OPEN = """
SELECT user_id AS document_id, CASE event_id % 9 WHEN 0 THEN 'page_text_missing' WHEN 1 THEN 'page_text_short' WHEN 2 THEN 'unreadable_parts' WHEN 3 THEN 'value_not_in_page_text' WHEN 4 THEN 'value_not_on_the_page'
       WHEN 5 THEN 'number_differs' WHEN 6 THEN 'repeated_value' WHEN 7 THEN 'possible_copy' ELSE 'date_to_check' END AS rule, event_type FROM events
"""


@query(f"""WITH f AS ({OPEN}), s AS (SELECT DISTINCT document_id, rule FROM f WHERE event_type = 'purchase'), o AS (SELECT *, CASE WHEN rule LIKE 'page_text%' OR rule LIKE 'unread%' THEN 'transcription_incomplete'
    WHEN rule LIKE 'value_not%' THEN 'value_not_on_the_page' WHEN rule IN ('number_differs', 'repeated_value') THEN 'checks_still_failing' ELSE 'other' END AS summary FROM f ANTI JOIN s USING (document_id, rule)),
  k AS (SELECT document_id, count(DISTINCT rule) AS rules, count(DISTINCT summary) AS summaries FROM o GROUP BY 1), m AS (SELECT * FROM o JOIN k USING (document_id))
  SELECT summary, rule, count(*) AS findings, count(DISTINCT document_id) AS documents, count(DISTINCT document_id) FILTER (rules = 1) AS only_here FROM m GROUP BY 1, 2
  UNION ALL SELECT summary, NULL, count(*), count(DISTINCT document_id), count(DISTINCT document_id) FILTER (summaries = 1) FROM m GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*), count(DISTINCT document_id), count(DISTINCT document_id) FROM m""")
def open_summaries(spark, sf_dir):
    """Open findings by rule, by what summarises it, and in all; settled ones are left out."""
    found = bound(spark, sf_dir, OPEN, "events")
    return rules.open_summaries(found.select("document_id", "rule"), found.where("event_type = 'purchase'"))


# ---------------------------------------------------------------- the vocabulary

# Spellings that two tests hold, the later edit owning them; some waiting, some of tests not approved.
STORED = """
SELECT split_part(p_name, ' ', 2) AS indicator_id, split_part(p_name, ' ', 2) AS label, CASE WHEN p_size = 50 THEN 'proposed' ELSE 'approved' END AS status,
       concat(CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END, CASE WHEN p_size < 20 THEN '''' ELSE '' END, ' ', CAST(p_size % 7 AS STRING)) AS spelling,
       p_retailprice > 1500 AS proposed, p_partkey AS edited FROM part
"""
NAMED = "SELECT l_orderkey, l_linenumber, concat(initcap(split_part(p_name, ' ', 1)), ' ', CAST(l_suppkey % 8 AS STRING)) AS name, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey"
_REFOLDED = f"""s AS ({STORED}), r AS (SELECT indicator_id, lower(replace(spelling, '''', '')) AS folded, arg_max(status, edited) AS status, bool_and(proposed) AS proposed, max(edited) AS edited FROM s GROUP BY 1, 2),
  a AS (SELECT * FROM r WHERE status = 'approved' AND NOT proposed), o AS (SELECT folded, arg_max(indicator_id, edited) AS owner FROM a GROUP BY 1)"""


@query(f"WITH {_REFOLDED}, c AS (SELECT folded, list_sort(list(DISTINCT indicator_id)) AS ids FROM a GROUP BY 1) SELECT folded, array_to_string(ids, ',') AS claimed_by, owner FROM c JOIN o USING (folded) WHERE len(ids) > 1")
def names_claimed_twice(spark, sf_dir):
    """Spellings that several tests hold, folded as of today, and the test that took each last."""
    out = vocabulary.names_claimed_twice(bound(spark, sf_dir, STORED, "part"))
    return out.select("folded", F.array_join("claimed_by", ",").alias("claimed_by"), "owner")


@query(f"""WITH {_REFOLDED}, v AS ({NAMED.replace("initcap(split_part(p_name, ' ', 1))", "split_part(p_name, ' ', 1)")})
  SELECT owner AS indicator_id, count(*) AS "values", round(sum(l_quantity), 2) AS total FROM v LEFT JOIN o ON folded = name GROUP BY 1""")
def values_to_indicators(spark, sf_dir):
    """Values by the test that owns their printed name."""
    met = vocabulary.values_to_indicators(bound(spark, sf_dir, NAMED, "lineitem", "part"), bound(spark, sf_dir, STORED, "part"))
    return met.groupBy("indicator_id").agg(F.count(F.lit(1)).alias("values"), F.round(F.sum("l_quantity"), 2).alias("total"))


_GROUPS = {
    "proposed": "SELECT o_custkey AS \"group\", o_orderpriority AS name FROM orders WHERE o_orderstatus <> 'P'",
    "settled": "SELECT p_size % 3 AS \"group\", CASE p_size % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-high' ELSE '3-MEDIUM' END AS name FROM part UNION ALL SELECT 0, '5-LOW' FROM part",
    "refused": "SELECT l_suppkey AS \"group\", CASE WHEN l_returnflag = 'A' THEN '4-NOT SPECIFIED' ELSE '2-HIGH' END AS name FROM lineitem",
}


@query(f"""WITH p AS (SELECT DISTINCT "group" AS g, lower(name) AS name FROM ({_GROUPS['proposed']})), t AS (SELECT DISTINCT "group" AS w, lower(name) AS name FROM ({_GROUPS['settled']})),
  r AS (SELECT DISTINCT array_to_string(list_sort(list(DISTINCT lower(name))), '|') AS signature FROM ({_GROUPS['refused']}) GROUP BY "group"),
  s AS (SELECT g, array_to_string(list_sort(list(name)), '|') AS signature, count(*) AS n FROM p GROUP BY 1),
  w AS (SELECT g, min(w) AS within FROM (SELECT g, w, count(*) AS k FROM p JOIN t USING (name) GROUP BY 1, 2) JOIN s USING (g) WHERE k = n GROUP BY 1),
  l AS (SELECT g, array_to_string(list_sort(list(name)), '|') AS left_over FROM p WHERE name NOT IN (SELECT name FROM t) GROUP BY 1)
  SELECT g AS "group", CASE WHEN signature IN (SELECT signature FROM r) THEN 'refused' WHEN within IS NOT NULL THEN 'settled' ELSE 'open' END AS verdict, within, coalesce(left_over, '') AS left_over
  FROM s LEFT JOIN w USING (g) LEFT JOIN l USING (g)""")
def group_decisions(spark, sf_dir):
    """Groups of names turned down before as exactly this set, within one settled group, or open; and what is left of them."""
    sets = {k: bound(spark, sf_dir, sql.replace('"group"', "`group`"), "orders", "part", "lineitem") for k, sql in ((k, v) for k, v in _GROUPS.items())}
    return vocabulary.group_decisions(**sets).withColumn("left_over", F.array_join("left_over", "|"))


_EVERYDAY = [(["red thing"], ["RED"]), (["nothing at all"], ["no such name"])]
_LANGUAGES = "SELECT coalesce(substring(o_orderpriority, 3, 20), 'not said') AS language, count(*) AS documents FROM orders GROUP BY 1"


@query(f"""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS id, lower(p_name) AS name FROM part), l AS ({_LANGUAGES})
  SELECT 'by name' AS question, 'test' AS kind, id AS answer, '' AS said, CAST(NULL AS BIGINT) AS documents FROM n WHERE contains(name, 'blue') GROUP BY id
  UNION ALL SELECT 'by word', 'test', id, 'Red thing', NULL FROM n WHERE contains(name, 'red') GROUP BY id
  UNION ALL SELECT 'by neither', 'language', language, 'nothing at all', documents FROM l""")
def tests_asked(spark, sf_dir):
    """A question that names answer, one that only an everyday word answers, and one that nothing does."""
    names = bound(spark, sf_dir, "SELECT split_part(p_name, ' ', 2) AS indicator_id, p_name AS name FROM part", "part")
    documents = bound(spark, sf_dir, "SELECT o_orderkey AS document_id, substring(o_orderpriority, 3, 20) AS language FROM orders", "orders")
    out = None
    for how, question in (("by name", "BLUE"), ("by word", "Red thing"), ("by neither", "nothing at all")):
        part = vocabulary.tests_asked(names, documents, question, _EVERYDAY).withColumn("question", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return out


# Lines with a doctor, and the name that each prints; without one, none proves itself.
SURNAMES = "Бережницький,Ставничук,Іваненко,Коваль,Петренко,Мельник,Шевченко"
DOCTOR_LINES = [
    ("Лікар: {s} А.В.", "{s} А.В."), ("Зав. відділенням    к.м.н.  [підпис]  О.П.{s}", "О.П.{s}"), ("Врач: КДЦ {s}  І. І.", "{s} І. І."), ("Лікар {s} Орися Павлівна", "{s} Орися Павлівна"), ("Направив лікар {s} А.В.", ""),
    ("Лікар {s}", ""), ("Лікарняний лист видано пацієнтові {s} А.В.", ""), ("Завідуюча КДЛ {s}", ""), ("DRA. MARTA OLIVERA", "MARTA OLIVERA"), ("Лікар {s} О.П. направив Інший І.І.", "{s} О.П."),
]
_D = len(DOCTOR_LINES)
_SURNAME = f"SELECT o_orderkey AS document_id, o_custkey % {_D} AS form, split_part('{SURNAMES}', ',', CAST(o_custkey % 7 + 1 AS INT)) AS s FROM orders"
PAPER = f"SELECT document_id, concat('Form 5\\n', {_case('form', [_concat(f[0]) for f in DOCTOR_LINES])}, '\\nend') AS text FROM ({_SURNAME}) AS o"


@query(f"""WITH o AS ({_SURNAME}), n AS (SELECT document_id, {_case('form', [_concat(f[1]) if f[1] else 'NULL' for f in DOCTOR_LINES])} AS name FROM o)
  SELECT name, count(DISTINCT document_id) AS documents, count(*) AS times FROM n WHERE name IS NOT NULL GROUP BY 1""")
def who_stands_in_the_text(spark, sf_dir):
    """Doctors that papers name, by a table function in a lateral join; each document counts once."""
    found = people.doctors_in_text(bound(spark, sf_dir, PAPER, "orders"))
    return people.who_stands_in_the_text(found).select("name", "documents", "times")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 97 = 5 AND l_orderkey > 300 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem),
  d AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)), k AS (SELECT l_orderkey, l_linenumber FROM d ORDER BY 1, 2 LIMIT 1)
  SELECT 'changed' AS run, l_orderkey, l_linenumber, count(*) AS in_one, count(*) AS in_other FROM a JOIN k USING (l_orderkey, l_linenumber) GROUP BY 2, 3""")
def snapshot_differences(spark, sf_dir):
    """The first key at which two runs differ, and none for two that are alike; only one range of keys is looked at."""
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    moved = F.when((F.col("l_suppkey") % 97 == 5) & (F.col("l_orderkey") > 300), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    other, one = one.withColumn("l_quantity", moved).drop("l_suppkey"), one.drop("l_suppkey")
    keys = ["l_orderkey", "l_linenumber"]
    changed = snapshots.first_difference(one, other, keys).withColumn("run", F.lit("changed"))
    alike = snapshots.first_difference(one, one.repartition("l_orderkey"), keys).withColumn("run", F.lit("alike"))
    return changed.unionByName(alike)


@query("SELECT 256 AS ranges, count(*) AS \"rows\", TRUE AS alike, FALSE AS changed_alike FROM lineitem")
def snapshot_digests(spark, sf_dir):
    """The root of the digests of a table, of the same rows in another order, and of a table with one row changed."""
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    last = one.agg(F.max("l_orderkey").alias("last"))
    other = one.crossJoin(F.broadcast(last)).withColumn("l_quantity", F.when(F.col("l_orderkey") == F.col("last"), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).drop("last")
    cut = snapshots.edges(one, keys)
    root = lambda t: snapshots.digests(t, keys, cut).where("level = 2").select("digest", "n")
    met = root(one).crossJoin(F.broadcast(root(one.repartition("l_orderkey")).select(F.col("digest").alias("same")))).crossJoin(F.broadcast(root(other).select(F.col("digest").alias("changed"))))
    return met.select(F.lit(snapshots.LEAVES).alias("ranges"), F.col("n").alias("rows"), (F.col("digest") == F.col("same")).alias("alike"), (F.col("digest") == F.col("changed")).alias("changed_alike"))


# ---------------------------------------------------------------- values placed by their numbers

# Tests of five kinds: a range beside the bare values; ends that agree; ends that do not, but pairs in time; none of these; a range that fits two scales.
PLACED = """
SELECT l_orderkey * 10 + l_linenumber AS observation_id, p_type AS indicator_id, CASE WHEN p_size % 2 = 0 THEN 'blood' END AS material, CAST(l_shipdate AS DATE) AS date,
       CASE WHEN l_returnflag = 'N' THEN '' WHEN l_returnflag = 'A' THEN 'g/l' ELSE 'mg/l' END AS scale,
       CASE length(p_type) % 5 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity WHEN 2 THEN power(2.0, year(l_shipdate) - 1990) WHEN 3 THEN l_quantity * CASE WHEN l_returnflag = 'N' THEN 30.0 ELSE 1.0 END ELSE l_quantity END
         * CASE WHEN l_returnflag = 'R' THEN 1000.0 ELSE 1.0 END AS number,
       CASE WHEN l_returnflag = 'N' AND length(p_type) % 5 = 0 THEN 1.0 WHEN l_returnflag = 'N' AND length(p_type) % 5 = 4 AND l_suppkey % 3 = 0 THEN 0.5 END AS low,
       CASE WHEN l_returnflag = 'N' AND length(p_type) % 5 = 0 THEN 30.0 + l_linenumber WHEN l_returnflag = 'N' AND length(p_type) % 5 = 4 AND l_suppkey % 3 = 0 THEN 60000.0 END AS high
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' OR length(p_type) % 5 <> 2 OR year(l_shipdate) < 1998
"""


@query(f"""WITH v AS ({PLACED}), n AS (SELECT * FROM v WHERE scale <> ''), x AS (SELECT * FROM v WHERE scale = ''),
  s AS (SELECT indicator_id AS i, material AS m, scale AS s, min(number) AS least, max(number) AS most FROM n GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  b AS (SELECT indicator_id AS i, material AS m, min(low) AS low, max(high) AS high, min(number) AS lo, max(number) AS hi FROM x GROUP BY 1, 2),
  c AS (SELECT b.*, s.s, least, most, low IS NOT NULL OR high IS NOT NULL AS ranged,
     least >= low / 2 AND most <= high * 2 AS by_range,
     CASE WHEN lo <> hi THEN greatest(lo, least) <= 2 * least(lo, least) AND greatest(hi, most) <= 2 * least(hi, most) ELSE lo >= least / 2 AND hi <= most * 2 END AS by_ends FROM b JOIN s ON b.i = s.i AND b.m IS NOT DISTINCT FROM s.m),
  d AS (SELECT indicator_id AS i, material AS m, scale AS s, date, min(number) AS y FROM n GROUP BY 1, 2, 3, 4),
  e AS (SELECT indicator_id AS i, material AS m, date, min(number) AS lo, max(number) AS hi FROM x GROUP BY 1, 2, 3),
  o AS (SELECT i, m, s FROM c WHERE NOT ranged AND NOT by_ends),
  p AS (SELECT e.i, e.m, o.s, e.date, any_value(e.lo) AS lo, any_value(e.hi) AS hi, arg_min(d.y, abs(d.date - e.date) * 1e9 + d.y) AS y FROM e JOIN o ON e.i = o.i AND e.m IS NOT DISTINCT FROM o.m JOIN d ON d.i = o.i AND d.m IS NOT DISTINCT FROM o.m AND d.s = o.s GROUP BY 1, 2, 3, 4),
  q AS (SELECT i, m, s FROM p GROUP BY 1, 2, 3 HAVING bool_and(greatest(lo, y) <= 2 * least(lo, y) AND greatest(hi, y) <= 2 * least(hi, y))),
  f AS (SELECT i, m, s, CASE WHEN ranged THEN 'range' ELSE 'ends' END AS how FROM c WHERE CASE WHEN ranged THEN by_range ELSE by_ends END UNION ALL SELECT i, m, s, 'pairs' FROM q),
  g AS (SELECT i, m, min(s) AS s, min(how) AS how FROM f GROUP BY 1, 2 HAVING count(*) = 1)
  SELECT x.indicator_id, x.material, coalesce(g.s, '') AS scale, count(*) AS "values" FROM x LEFT JOIN g ON g.i = x.indicator_id AND g.m IS NOT DISTINCT FROM x.material GROUP BY 1, 2, 3""")
def values_placed(spark, sf_dir):
    """Values without a unit on the scale that ranges, spreads or neighbours in time leave; by test."""
    rows = bound(spark, sf_dir, PLACED, "lineitem", "part").withColumns({c: F.col(c).cast("double") for c in ("number", "low", "high")})
    placed = series.placed_by_numbers(rows.withColumn("bare", F.col("scale") == ""))
    return placed.where("bare").groupBy("indicator_id", "material", "scale").agg(F.count(F.lit(1)).alias("values"))


# ---------------------------------------------------------------- dates of documents, habits of forms, corrections of lines

DATES = """
SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 11 = 0 THEN CAST(o_orderdate AS DATE) END AS person, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS study,
       CASE WHEN o_custkey % 4 <> 0 THEN CAST('1995-06-17' AS DATE) END AS report, CASE WHEN o_custkey % 5 <> 0 THEN CAST('1996-01-01' AS DATE) END AS page_date, CASE WHEN o_custkey % 2 = 0 THEN CAST('1890-01-01' AS DATE) END AS second_look,
       CASE WHEN o_custkey % 7 = 0 THEN CAST(o_orderdate AS DATE) END AS born, CASE WHEN o_custkey % 13 > 0 THEN 'printed' END AS printed, o_custkey % 17 = 0 AS ambiguous FROM orders
"""


@query(f"""WITH d AS ({DATES}), s AS (SELECT *, CASE WHEN study IS DISTINCT FROM born THEN study END AS s, CASE WHEN report IS DISTINCT FROM born THEN report END AS r, CASE WHEN page_date IS DISTINCT FROM born THEN page_date END AS p FROM d),
  p AS (SELECT *, coalesce(person, s, r, p, second_look) AS day, CASE WHEN person IS NOT NULL THEN 'person' WHEN s IS NOT NULL THEN 'study' WHEN r IS NOT NULL THEN 'report' WHEN p IS NOT NULL THEN 'page_date' WHEN second_look IS NOT NULL THEN 'second_look' END AS how FROM s)
  SELECT document_id, day AS date, how AS date_source, array_to_string(list_filter([CASE WHEN day IS NULL AND printed IS NOT NULL THEN 'not_read' END, CASE WHEN how IS DISTINCT FROM 'person' AND ambiguous THEN 'ambiguous' END,
    CASE WHEN day > DATE '1998-01-01' THEN 'future' END, CASE WHEN year(day) < 1900 THEN 'early' END, CASE WHEN how IS DISTINCT FROM 'person' AND abs(study - report) > 60 THEN 'apart' END,
    CASE WHEN how IS DISTINCT FROM 'person' AND born IN (study, report, page_date) THEN 'birth_date' END, CASE WHEN how = 'second_look' THEN 'second_look' END], lambda x: x IS NOT NULL), ',') AS flags FROM p""")
def document_dates(spark, sf_dir):
    """The date of each document, by whose word, and what is to be said of it; dates of birth never count."""
    rows = bound(spark, sf_dir, DATES, "orders").withColumn("birth_dates", F.array_compact(F.array("born")))
    out = reading.document_dates(rows, F.lit("1998-01-01").cast("date"))
    return out.select("document_id", "date", "date_source", F.array_join("date_flags", ",").alias("flags"))


@query("""WITH d AS (SELECT o_orderkey AS document_id, o_custkey % 50 AS provider, day(o_orderdate) AS d, month(o_orderdate) AS m, o_custkey % 50 < 25 AS first FROM orders),
  t AS (SELECT document_id, provider, d > 12 AND first AS day, d > 12 AND NOT first AND m <= 12 AS month FROM d), o AS (SELECT document_id, provider, bool_or(day) AS a, bool_or(month) AS b FROM t GROUP BY 1, 2),
  p AS (SELECT provider, bool_or(day) AS a, bool_or(month) AS b FROM t GROUP BY 1)
  SELECT document_id, CASE WHEN o.a AND NOT o.b THEN TRUE WHEN o.b AND NOT o.a THEN FALSE WHEN p.a AND NOT p.b THEN TRUE WHEN p.b AND NOT p.a THEN FALSE END AS day_first FROM o JOIN p USING (provider)""")
def day_first_habits(spark, sf_dir):
    """Whether a document writes the day first, by its own dates or else by those of its provider."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 50).alias("provider"), F.date_format("o_orderdate", "dd").alias("d"), F.date_format("o_orderdate", "MM").alias("m"))
    printed = F.when(F.col("provider") < 25, F.concat_ws("/", "d", "m", F.lit("1995"))).otherwise(F.concat_ws("/", "m", "d", F.lit("1995")))
    return reading.day_first_evidence(rows.select("document_id", "provider", printed.alias("printed")))


EDITS = "SELECT user_id AS document, CASE WHEN event_type = 'view' THEN concat('k', CAST(event_id % 5 AS STRING)) ELSE concat('s', CAST(event_id % 4 AS STRING)) END AS edit_key, CAST(event_id AS STRING) AS value, event_id AS seq FROM events"
LINED = "SELECT DISTINCT user_id AS document, concat('k', CAST(event_id % 7 AS STRING)) AS key, concat('s', CAST(event_id % 7 % 5 AS STRING)) AS short_key, concat('line ', CAST(event_id % 7 AS STRING)) AS value FROM events"


@query(f"""WITH e AS ({EDITS}), l AS ({LINED}), s AS (SELECT document, edit_key, arg_max(value, seq) AS v FROM e GROUP BY 1, 2), o AS (SELECT document, short_key FROM l GROUP BY 1, 2 HAVING count(*) = 1)
  SELECT l.document, l.key, coalesce(f.v, h.v, l.value) AS value, coalesce(f.v, h.v) IS NOT NULL AS corrected FROM l LEFT JOIN s f ON f.document = l.document AND f.edit_key = l.key
    LEFT JOIN (SELECT s.* FROM s JOIN o ON o.document = s.document AND o.short_key = s.edit_key) h ON h.document = l.document AND h.edit_key = l.short_key""")
def lines_corrected(spark, sf_dir):
    """Corrections that name a line by its key, or, if they are old, by a short key that one line alone has."""
    out = overlay.overlay_by_line(bound(spark, sf_dir, LINED, "events"), bound(spark, sf_dir, EDITS, "events"))
    return out.select("document", "key", "value", "corrected")


# ---------------------------------------------------------------- substances and eyes

# Tests, printed names, units, and what one is worth on the scale of the substance.
SUBSTANCES = [
    ("creatinine", "Креатинін крові", "mg/dl", "umol/l", 88.4), ("creatinine", "креатинiн", "мкмоль/л", "umol/l", 1.0), ("indicator-7", "Γλυκόζη", "mg/dL", "mmol/l", 0.0555), ("glucose", "Глюкоза", "ммоль/л", "mmol/l", 1.0),
    ("urine-creatinine", "Creatinine", "mg/dl", None, None), ("hemoglobin", "Гемоглобін", "г/дл", "g/l", 10.0), ("hemoglobin", "Hb", "g/dl", None, None), ("iron", "Hierro", "µg/dL", "umol/l", 0.1791), ("total-cholesterol", "Colesterol total", "mg/dl", "mmol/l", 0.02586),
    ("indicator", "Белок общий", "g/dl", "g/l", 10.0), ("glucose", "Glucose", "g/l", None, None), (None, "Urea", "mg/dl", None, None), ("uric-acid", "Сечова кислота", "ммоль/л", "umol/l", 1000.0),
]
_quoted = lambda x: "NULL" if x is None else "'" + x + "'"
_K = len(SUBSTANCES)
TAKEN = f"SELECT l_orderkey, l_linenumber, l_quantity AS value_numeric, {_case(f'l_suppkey % {_K}', [_quoted(r[0]) for r in SUBSTANCES])} AS indicator_id, {_case(f'l_suppkey % {_K}', [_quoted(r[1]) for r in SUBSTANCES])} AS name, {_case(f'l_suppkey % {_K}', [_quoted(r[2]) for r in SUBSTANCES])} AS unit FROM lineitem"


@query(f"""WITH f AS (SELECT l_quantity, {_case(f'l_suppkey % {_K}', [_quoted(r[3]) for r in SUBSTANCES])} AS scale, {_case(f'l_suppkey % {_K}', ['CAST(NULL AS DOUBLE)' if r[4] is None else f'CAST({r[4]} AS DOUBLE)' for r in SUBSTANCES])} AS factor FROM lineitem)
  SELECT scale, factor, count(*) AS "values", round(sum(l_quantity * factor), 3) AS total FROM f GROUP BY 1, 2""")
def values_converted(spark, sf_dir):
    """Values brought to the scale of their substance, where the test and the printed name both say it, in five languages."""
    out = converted(bound(spark, sf_dir, TAKEN, "lineitem"))
    return out.groupBy(F.col("to_scale").alias("scale"), F.col("to_factor").alias("factor")).agg(F.count(F.lit(1)).alias("values"), F.round(F.sum("converted"), 3).alias("total"))


# Names and lines of eye examinations; {q} is a number of the row.
EYED = [
    ("OD", "Vis {q} sph -{q} cyl 2 ax 95", "the right eye", "visual acuity,sphere,cylinder,axis"), ("ОС.", "сфера {q} циліндр -1,5 ось", "the left eye", "sphere,cylinder"), ("OU:", "ось {q}", "both eyes", ""), ("Vis OD", "visus {q}", None, "visual acuity"),
    ("OS", "ΣΦΑΊΡΑ {q} ΚΎΛΙΝΔΡΟΣ 1 ΆΞΟΝΑΣ 90", "the left eye", "sphere,cylinder,axis"), ("oд", "esfera {q} eje 5", "the right eye", "sphere,axis"), ("max", "sphincter {q} max 5", None, ""), ("ОУ", "eje eléctrico {q}º", "both eyes", ""),
]
_Y = len(EYED)
LOOKED = f"SELECT l_orderkey, l_linenumber, {_case('form', [_quoted(r[0]) for r in EYED])} AS name, {_case('form', [_concat(r[1]) for r in EYED])} AS line FROM (SELECT l_orderkey, l_linenumber, l_suppkey % {_Y} AS form, CAST(l_quantity AS INT) AS q FROM lineitem) AS l"


@query(f"""WITH f AS (SELECT {_case(f'l_suppkey % {_Y}', [_quoted(r[2]) for r in EYED])} AS eye, {_case(f'l_suppkey % {_Y}', [_quoted(r[3]) for r in EYED])} AS measured FROM lineitem)
  SELECT eye, measured, count(*) AS "values" FROM f GROUP BY 1, 2""")
def eyes_measured(spark, sf_dir):
    """Names that are nothing but an eye, and what the lines beside them measure."""
    rows = bound(spark, sf_dir, LOOKED, "lineitem")
    out = rows.select(the_eye_alone(F.col("name")).alias("eye"), F.array_join(measurements_named(F.col("line")), ",").alias("measured"))
    return out.groupBy("eye", "measured").agg(F.count(F.lit(1)).alias("values"))
