"""The registered queries of the library and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.parsing import on_distinct
from .functions.units import onto_one_scale, unit_key, unit_of_range
from .functions.materials import heading_tests, inverted_tables
from .functions.person import birth_dates, dates_disagree, sex_printed
from .functions.text import address, fold, sliding_windows, stems, text_pages, words
from .operators import compaction, copies, graph, islands, joins, overlay, rules, suspects
from .plans.archive import IS_RESULT, Filters, material_key, verdict
from .plans import people, reading, series, views, work
from .plans.bindings import DOCUMENTS, WITH, archive, bound, table
from .plans.search import count_hits, found, hits, indicators_matching, keep_index, kept_hits, lengths_of, postings, row_postings
from .session import shared_folder
from .sources.store import Store
from .streaming import expiring, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the same in SQL where SQL can say it."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


PRIMARY = "doc_type NOT IN ('blank') AND primary_copy"

# ---------------------------------------------------------------- documents


@query(f"""{WITH} SELECT
  (SELECT count(*) FROM docs WHERE primary_copy) AS documents,
  (SELECT count(*) FROM docs WHERE primary_copy AND transcribed) AS transcribed,
  (SELECT count(*) FROM docs WHERE primary_copy AND date IS NULL) AS without_date,
  (SELECT min(date) FROM docs WHERE primary_copy) AS first_date,
  (SELECT max(date) FROM docs WHERE primary_copy) AS last_date,
  (SELECT count(DISTINCT file_id) FROM docs) AS files,
  (SELECT count(DISTINCT copy_group) FROM docs) AS copy_groups,
  (SELECT count(*) FROM obs JOIN docs USING (document_id)) AS values_all,
  (SELECT count(*) FROM obs JOIN docs USING (document_id) WHERE primary_copy) AS values_primary""")
def overview(spark, sf_dir):
    return archive(spark, sf_dir).overview()


flagship = overview


@query(f"""{WITH} SELECT 'type' AS kind, doc_type AS label, count(*) AS documents FROM docs WHERE primary_copy GROUP BY doc_type
  UNION ALL SELECT 'language', coalesce(language, 'not said'), count(*) FROM docs WHERE primary_copy GROUP BY 2""")
def histograms(spark, sf_dir):
    return archive(spark, sf_dir).histograms()


@query(f"{WITH} SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS documents FROM docs WHERE {PRIMARY} AND date IS NOT NULL GROUP BY 1")
def year_histogram(spark, sf_dir):
    return archive(spark, sf_dir).years(Filters())


@query(f"{WITH} SELECT coalesce(language, 'not said') AS language, count(*) AS documents FROM docs GROUP BY 1")
def language_counts(spark, sf_dir):
    return archive(spark, sf_dir).language_counts()


@query(f"""{WITH}, d AS (SELECT * FROM docs WHERE {PRIMARY} AND date IS NOT NULL)
  SELECT doc_type, CAST(year(date) AS BIGINT) AS year, count(*) AS documents, CAST(sum(count(*)) OVER (PARTITION BY doc_type) AS BIGINT) AS in_lane
  FROM d GROUP BY doc_type, year(date)""")
def lanes(spark, sf_dir):
    return archive(spark, sf_dir).lanes(Filters())


@query(f"""{WITH}, page AS (SELECT * FROM docs WHERE doc_type NOT IN ('blank', 'admin', 'insurance') AND primary_copy
    AND date >= DATE '1996-01-01' AND date <= DATE '1999-12-31' ORDER BY date DESC NULLS LAST, document_id LIMIT 50 OFFSET 10)
  SELECT document_id, date, doc_type, provider, (SELECT count(*) FROM obs o WHERE o.document_id = page.document_id) AS value_count FROM page""")
def timeline_page(spark, sf_dir):
    return archive(spark, sf_dir).timeline(Filters(since="1996-01-01", until="1999-12-31", paperwork=False), 50, 10)


@query(f"""{WITH}, page AS (SELECT * FROM docs WHERE {PRIMARY} AND date IS NULL ORDER BY document_id LIMIT 200)
  SELECT document_id, date, doc_type, provider, (SELECT count(*) FROM obs o WHERE o.document_id = page.document_id) AS value_count FROM page""")
def timeline_undated(spark, sf_dir):
    return archive(spark, sf_dir).timeline(Filters(undated=True), 500)


@query(f"""{WITH} SELECT count(*) AS documents, min(date) AS first_date, max(date) AS last_date FROM docs
  WHERE doc_type = 'report' AND primary_copy AND provider IN ('Clinic 3', 'Clinic 5') AND doctor IN ('Dr 5', 'Dr 43', 'Dr 25')""")
def count_documents(spark, sf_dir):
    return archive(spark, sf_dir).count_documents(
        Filters(doc_type="report", providers=["Clinic 3", "Clinic 5"], doctors=["Dr 5", "Dr 43", "Dr 25"])
    )


@query(f"""{WITH}, m AS (SELECT date, 'institution' AS kind, provider AS name FROM docs WHERE primary_copy
    UNION ALL SELECT date, 'doctor', doctor FROM docs WHERE primary_copy)
  SELECT kind, name, count(*) AS documents, min(date) AS first_date, max(date) AS last_date FROM m WHERE trim(coalesce(name, '')) <> '' GROUP BY kind, name""")
def who_made_them(spark, sf_dir):
    return archive(spark, sf_dir).who_made_them()


@query(f"""{WITH} SELECT count(*) FILTER (WHERE primary_copy AND trim(coalesce(provider, '')) <> '') AS name_an_institution,
  count(*) FILTER (WHERE primary_copy AND trim(coalesce(doctor, '')) <> '') AS name_a_doctor FROM docs""")
def how_many_name_them(spark, sf_dir):
    return archive(spark, sf_dir).how_many_name_them()


@query(f"""{WITH}, g AS (SELECT copy_group, document_id, date, row_number() OVER (PARTITION BY copy_group ORDER BY
    CASE WHEN doc_type = 'lab_panel' THEN 0 ELSE 1 END, CASE WHEN transcribed THEN 0 ELSE 1 END, document_id) AS r,
    count(*) OVER (PARTITION BY copy_group) AS members FROM docs WHERE copy_group IS NOT NULL)
  SELECT CAST(copy_group AS DOUBLE) AS copy_group, document_id, members FROM g WHERE r = 1 AND members > 1""")
def primary_of_copies(spark, sf_dir):
    grouped = archive(spark, sf_dir).documents.where("copy_group is not null")
    members = grouped.groupBy("copy_group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    ranking = [F.when(F.col("doc_type") == "lab_panel", 0).otherwise(1), F.when(F.col("transcribed"), 0).otherwise(1), F.col("document_id")]
    best = copies.primary_copies(grouped.join(members, "copy_group"), ranking)
    return best.select(F.col("copy_group").cast("double").alias("copy_group"), "document_id", "members")


# ---------------------------------------------------------------- values

KEY = "CASE WHEN material IS NOT NULL AND trim(material) <> '' THEN material WHEN material_source = 'no sample' THEN 'not_a_sample' ELSE 'unknown' END"
DRAWN = f"indicator_id IS NOT NULL AND date IS NOT NULL AND primary_copy AND NOT derived AND {IS_RESULT}"


@query(f"""{WITH} SELECT observation_id, document_id, date, name, value_numeric, unit FROM obs JOIN docs USING (document_id)
  WHERE primary_copy AND lower(name) LIKE '%red%' AND lower(name) LIKE '%bolt%' ORDER BY date NULLS LAST, document_id, observation_id LIMIT 5000""")
def values_of_test(spark, sf_dir):
    return archive(spark, sf_dir).values(9999, cap=5000, name="BOLT réd")


@query(f"""{WITH} SELECT count(*) AS values_found FROM obs JOIN docs USING (document_id)
  WHERE (lower(name) LIKE '%ring%' OR indicator_id IN ('gear')) AND primary_copy AND NOT derived AND ({KEY}) = 'unknown'""")
def count_values(spark, sf_dir):
    rows = archive(spark, sf_dir).matching(name="ring", indicators=["gear"], material="unknown", derived=False)
    return rows.agg(F.count(F.lit(1)).alias("values_found"))


@query(f"""{WITH} SELECT lower(name) AS folded, unit, count(*) AS values, min(date) AS first_date, max(date) AS last_date, min(name) AS name
  FROM obs JOIN docs USING (document_id) WHERE lower(name) LIKE '%ed%' GROUP BY 1, 2""")
def value_names(spark, sf_dir):
    return archive(spark, sf_dir).value_names("ED")


@query(f"""{WITH} SELECT lower(name) AS folded, count(*) AS values, count(DISTINCT unit) AS units, min(date) AS first_date, max(date) AS last_date,
  coalesce(string_agg(DISTINCT unit, ',' ORDER BY unit), '') AS unit_list FROM obs JOIN docs USING (document_id) WHERE primary_copy GROUP BY 1""")
def printed_names(spark, sf_dir):
    return archive(spark, sf_dir).printed_names()


@query(f"""{WITH}, v AS (SELECT indicator_id, date, {KEY} AS k FROM obs JOIN docs USING (document_id) WHERE primary_copy AND {IS_RESULT})
  SELECT i.indicator_id, i.label, count(v.k) AS values, min(v.date) AS first_date, max(v.date) AS last_date, count(DISTINCT v.k) AS materials
  FROM inds i LEFT JOIN v ON i.indicator_id = v.indicator_id GROUP BY 1, 2""")
def test_list(spark, sf_dir):
    return archive(spark, sf_dir).indicator_list()


@query(f"""{WITH}, v AS (SELECT indicator_id, date, document_id, observation_id, value_numeric, {KEY} AS k FROM obs JOIN docs USING (document_id) WHERE {DRAWN})
  SELECT indicator_id, count(*) AS points, min(date) AS first_date, max(date) AS last_date, count(DISTINCT k) AS materials,
  CASE WHEN count(DISTINCT k) = 1 THEN arg_max(value_numeric, {{'d': date, 'o': document_id, 'i': observation_id}}) END AS last_value FROM v GROUP BY 1""")
def test_timeline(spark, sf_dir):
    return archive(spark, sf_dir).indicator_timeline()


@query(f"{WITH} SELECT {KEY} AS material, count(*) AS values FROM obs JOIN docs USING (document_id) WHERE {DRAWN} GROUP BY 1")
def material_tabs(spark, sf_dir):
    return archive(spark, sf_dir).materials_present()


@query(f"""{WITH} SELECT observation_id, document_id, name, value_numeric FROM obs JOIN docs USING (document_id)
  WHERE {DRAWN} AND ({KEY}) = 'unknown'""")
def values_with_no_material(spark, sf_dir):
    rows = archive(spark, sf_dir).drawn().where(material_key() == "unknown")
    return rows.select("observation_id", "document_id", "name", "value_numeric")


@query(f"""{WITH} SELECT observation_id, document_id, flag, value_numeric FROM obs JOIN docs USING (document_id)
  WHERE primary_copy AND trim(coalesce(flag, '')) <> '' AND lower(trim(flag)) = 'r'""")
def flagged(spark, sf_dir):
    return archive(spark, sf_dir).flagged("R").select("observation_id", "document_id", "flag", "value_numeric")


#: Ranges by unit: both ends, one end, none; the missing unit has no row.
RANGES = "(VALUES ('mg/l', 10.0, 40.0), ('mmol/l', NULL, 30.0), ('g/l', NULL, NULL))"


@query(f"""{WITH}, v AS (SELECT unit, CASE WHEN r.u IS NULL THEN 'no_range_printed'
    WHEN lo IS NULL AND hi IS NULL THEN 'cannot_tell' WHEN coalesce(value_numeric < lo, false) OR coalesce(value_numeric > hi, false) THEN 'outside' ELSE 'inside' END AS verdict
  FROM obs JOIN docs USING (document_id) LEFT JOIN (SELECT * FROM {RANGES} t(u, lo, hi)) r ON unit = r.u WHERE primary_copy)
  SELECT unit, verdict, count(*) AS values FROM v GROUP BY 1, 2""")
def flagged_vs_range(spark, sf_dir):
    ranges = spark.createDataFrame([("mg/l", 10.0, 40.0), ("mmol/l", None, 30.0), ("g/l", None, None)], "unit string, lo double, hi double")
    rows = archive(spark, sf_dir).joined().where("primary_copy").join(F.broadcast(ranges.withColumn("ranged", F.lit(True))), "unit", "left")
    told = verdict(F.col("value_numeric"), F.col("lo"), F.col("hi"))
    kind = F.when(F.col("ranged").isNull(), "no_range_printed").when(told.isNull(), "cannot_tell").when(told, "outside").otherwise("inside")
    return rows.groupBy("unit", kind.alias("verdict")).agg(F.count(F.lit(1)).alias("values"))


@query(f"""{WITH}, c AS (SELECT o.*, first_value(unit IGNORE NULLS) OVER (PARTITION BY document_id, name, page ORDER BY observation_id, price
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS row_unit FROM obs o)
  SELECT coalesce(unit, row_unit) AS unit_effective, count(*) AS values FROM c GROUP BY 1""")
def unit_of_the_row(spark, sf_dir):
    w = Window.partitionBy("document_id", "name", "page").orderBy("observation_id", "price").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = archive(spark, sf_dir).observations.withColumn("row_unit", F.first("unit", ignorenulls=True).over(w))
    return rows.groupBy(F.coalesce("unit", "row_unit").alias("unit_effective")).agg(F.count(F.lit(1)).alias("values"))


# ---------------------------------------------------------------- rules over values


def _by(spark, sf_dir):
    return archive(spark, sf_dir).joined().where("primary_copy").where(IS_RESULT)


@query(f"""{WITH}, v AS (SELECT observation_id, price, name FROM obs JOIN docs USING (document_id) WHERE primary_copy AND {IS_RESULT} AND price > 0),
  m AS (SELECT name, median(price) AS m, count(*) AS n FROM v GROUP BY 1)
  SELECT observation_id, name, price, round(m, 6) AS median, n AS readings FROM v JOIN m USING (name) WHERE n >= 4 AND (price >= 10 * m OR price * 10 <= m)""")
def suspect_far_from_median(spark, sf_dir):
    found = suspects.far_from_median(_by(spark, sf_dir), ["name"], "price", 10.0, 4)
    return found.select("observation_id", "name", "price", F.round("median", 6).alias("median"), "readings")


@query(f"""{WITH}, h AS (SELECT document_id AS test, unit, count(*) AS n FROM obs WHERE unit IS NOT NULL GROUP BY 1, 2), t AS (SELECT test, sum(n) AS a FROM h GROUP BY 1)
  SELECT test, unit, n FROM h JOIN t USING (test) WHERE n <= 1 AND a - n >= 4""")
def suspect_lone_unit(spark, sf_dir):
    values = archive(spark, sf_dir).observations.withColumn("test", F.col("document_id"))
    return suspects.lone_units(values, "test", "unit", 1, 4)


@query(f"""{WITH}, h AS (SELECT document_id, count(unit) AS k FROM obs GROUP BY 1)
  SELECT observation_id, document_id, k AS with_unit FROM obs JOIN h USING (document_id) WHERE unit IS NULL AND k >= 4""")
def suspect_missing_unit(spark, sf_dir):
    return suspects.unit_missing(archive(spark, sf_dir).observations, "document_id", "unit", 4).select("observation_id", "document_id", "with_unit")


@query(f"""{WITH}, f AS (SELECT document_id AS document, 'no_unit' AS rule, 1 AS w FROM obs WHERE unit IS NULL
    UNION ALL SELECT document_id, 'flagged', 3 FROM obs WHERE flag = 'R'
    UNION ALL SELECT document_id, 'no_title', 2 FROM docs WHERE title IS NULL AND doc_type = 'lab_panel' AND transcribed),
  c AS (SELECT document, rule, w, count(*) AS n FROM f GROUP BY 1, 2, 3)
  SELECT document, CAST(sum(w * least(n, 3)) AS BIGINT) AS weight FROM c GROUP BY 1""")
def suspect_score(spark, sf_dir):
    a = archive(spark, sf_dir)
    found = [
        a.observations.where("unit is null").select(F.col("document_id").alias("document"), F.lit("no_unit").alias("rule")),
        a.observations.where("flag = 'R'").select("document_id", F.lit("flagged")),
        a.documents.where("title is null and doc_type = 'lab_panel' and transcribed").select("document_id", F.lit("no_title")),
    ]
    weights = spark.createDataFrame([("no_unit", 1), ("flagged", 3), ("no_title", 2)], "rule string, weight long")
    return suspects.suspicion(found[0].union(found[1]).union(found[2]), weights)


@query(f"""{WITH} SELECT document_id, name, unit, value_numeric, count(*) - 1 AS findings FROM obs GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def repeated_value(spark, sf_dir):
    keys = ["document_id", "name", "unit", "value_numeric"]
    return archive(spark, sf_dir).observations.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("findings")).where("findings > 0")


@query(f"""{WITH} SELECT document_id, page, name FROM obs GROUP BY 1, 2, 3 HAVING NOT bool_or({IS_RESULT})""")
def row_without_result(spark, sf_dir):
    rows = archive(spark, sf_dir).observations.groupBy("document_id", "page", "name").agg(F.bool_or(F.expr(IS_RESULT)).alias("any"))
    return rows.where("not any").drop("any")


@query("""SELECT l_orderkey AS document_id, CAST(datediff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS BIGINT) AS days
  FROM lineitem GROUP BY 1 HAVING datediff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) > 60""")
def dates_far_apart(spark, sf_dir):
    d = F.datediff(F.max(F.col("l_shipdate").cast("date")), F.min(F.col("l_shipdate").cast("date"))).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(d.alias("days")).where("days > 60")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, p_brand, l_extendedprice AS mid FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0),
  m AS (SELECT p_brand, median(log10(mid)) AS m, count(*) AS n FROM r GROUP BY 1),
  s AS (SELECT p_brand, avg(CASE WHEN abs(log10(mid) - m) >= 0.9 THEN 0.0 ELSE 1.0 END) AS s FROM r JOIN m USING (p_brand) WHERE n >= 5 GROUP BY 1)
  SELECT l_orderkey, l_linenumber, p_brand, mid FROM r JOIN m USING (p_brand) JOIN s USING (p_brand) WHERE s >= 0.75 AND abs(log10(mid) - m) >= 0.9""")
def powers_of_ten(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", F.col("l_extendedprice").alias("mid"))
    return suspects.powers_from_the_rest(rows, "p_brand", "mid", 5, 0.75, 0.9).select("l_orderkey", "l_linenumber", "p_brand", "mid")


@query(f"""{WITH} SELECT document_id FROM docs d WHERE doc_type = 'lab_panel' AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.document_id = d.document_id)""")
def lab_without_values(spark, sf_dir):
    a = archive(spark, sf_dir)
    return a.documents.where("doc_type = 'lab_panel'").join(a.observations, "document_id", "left_anti").select("document_id")


# ---------------------------------------------------------------- copies and names


@query("""WITH t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) SELECT doc_id AS id, f AS copy_of FROM t WHERE doc_id <> f""")
def exact_copies(spark, sf_dir):
    return copies.exact_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


NEAR = """i AS (SELECT DISTINCT l_orderkey AS document, l_partkey % 6 AS item FROM lineitem),
  h AS (SELECT o_orderkey AS document, o_custkey AS file, date_trunc('day', o_orderdate) AS date FROM orders),
  s AS (SELECT document, count(*) AS n FROM i GROUP BY 1), x AS (SELECT i.document, i.item, h.file, h.date, s.n FROM i JOIN h USING (document) JOIN s USING (document)),
  p AS (SELECT a.document AS a, b.document AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.date = b.date AND a.item = b.item
        WHERE a.document < b.document AND a.file <> b.file GROUP BY 1, 2, 3, 4),
  q AS (SELECT a, b, shared FROM p WHERE (shared = na AND shared = nb) OR (shared = least(na, nb) AND shared >= 3)
        OR (least(na, nb) >= 5 AND least(na, nb) >= 0.6 * greatest(na, nb) AND shared >= 0.8 * least(na, nb)))"""


def _papers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_partkey") % 6).alias("item"))
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("file"), F.col("o_orderdate").cast("date").alias("date")
    )
    return heads, lines


@query(f"WITH {NEAR} SELECT a, b, shared FROM q")
def near_copies(spark, sf_dir):
    return copies.possible_copies(*_papers(spark, sf_dir))


@query(f"""WITH RECURSIVE {NEAR}, e AS (SELECT a AS x, b AS y FROM q UNION SELECT b, a FROM q),
  r AS (SELECT DISTINCT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x)
  SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def copy_components(spark, sf_dir):
    return copies.copy_groups(*_papers(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, list_distinct(string_split(name, ' ')) AS ws FROM n)
  SELECT s.stem, count(DISTINCT s.name) AS names FROM (SELECT name, unnest(list_distinct(list_transform(list_filter(ws, lambda x: length(x) >= 5), lambda x: substring(x, 1, 5)))) AS stem FROM w) s GROUP BY 1""")
def coverage_stems(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.explode(stems(fold(F.col("name")))).alias("stem")).groupBy("stem").agg(F.countDistinct("name").alias("names"))


# ---------------------------------------------------------------- logs and time


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) r FROM events) WHERE r = 1""")
def latest_wins(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return compaction.latest_by(log, ["user_id", "event_type"], "event_id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 5000")
def retention_newest_n(spark, sf_dir):
    return compaction.newest_n(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 5000, "event_id")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) r FROM events) WHERE r <= 8""")
def newest_per_key(spark, sf_dir):
    return compaction.newest_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 8)


EDITS = """edits AS (SELECT event_id AS seq, user_id * 7 AS document_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS value, event_type = 'error' AS removed FROM events),
  standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq DESC) r FROM edits) WHERE r = 1)"""


def _edits(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 7).alias("document_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("value"),
        (F.col("event_type") == "error").alias("removed"),
    )


@query(f"""{WITH}, {EDITS} SELECT d.document_id, coalesce(s.value, d.doc_type) AS doc_type, s.value IS NOT NULL AS corrected
  FROM docs d LEFT JOIN standing s ON d.document_id = s.document_id WHERE NOT coalesce(s.removed, false)""")
def overlay_corrections(spark, sf_dir):
    rows = archive(spark, sf_dir).documents.select("document_id", "doc_type")
    return overlay.overlay(rows, _edits(spark, sf_dir), ["document_id"], "doc_type").select("document_id", "doc_type", "corrected")


@query(f"WITH {EDITS} SELECT document_id, seq FROM standing s WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = s.document_id AND o_orderstatus = 'F')")
def unmatched_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    return overlay.unmatched(_edits(spark, sf_dir), rows, ["document_id"]).select("document_id", "seq")


@query("""WITH a AS (SELECT l_orderkey, l_partkey % 10 AS k, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
  b AS (SELECT l_orderkey, l_partkey % 10 AS k, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
  SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.k, b.k) AS k,
  CASE WHEN b.k IS NULL THEN 'only_ours' WHEN a.k IS NULL THEN 'only_theirs' WHEN a.q IS DISTINCT FROM b.q OR a.f IS DISTINCT FROM b.f THEN 'differs' ELSE 'agreed' END AS standing,
  coalesce(a.k IS NOT NULL AND b.k IS NOT NULL AND a.q IS DISTINCT FROM b.q, false) AS q_differs, coalesce(a.k IS NOT NULL AND b.k IS NOT NULL AND a.f IS DISTINCT FROM b.f, false) AS f_differs
  FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.k = b.k""")
def recheck_compare(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") % 10)
    read = lambda parity: lines.where(f"l_linenumber % 2 = {parity}").groupBy("l_orderkey", "k").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    return joins.compare_readings(read(0), read(1), ["l_orderkey", "k"], ["q", "f"])


@query("""WITH f AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' OR lag(role) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, role, CAST(sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM f""")
def document_islands(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return islands.islands(rows, ["conv_id"], ["turn"], F.col("role") == "user")


@query("""WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS b FROM events),
  i AS (SELECT user_id, event_type, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM f) SELECT user_id, island, event_type, count(*) AS rows FROM i GROUP BY 1, 2, 3""")
def table_islands(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    moved = ~F.col("event_type").eqNullSafe(islands.before("event_type", ["user_id"], ["event_id"]))
    return islands.islands(rows, ["user_id"], ["event_id"], moved).groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT conv_id, turn, CASE WHEN lag(turn) OVER w = turn - 1 THEN lag(role) OVER w END AS carried FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def carry_previous(spark, sf_dir):
    keys, order = ["conv_id"], ["turn"]
    near = islands.before("turn", keys, order) == F.col("turn") - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(near, islands.before("role", keys, order)).alias("carried"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
  c AS (SELECT p.event_id, v.value, abs(epoch_us(p.ts) - epoch_us(v.ts)) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.value) r FROM p JOIN v ON p.user_id = v.user_id)
  SELECT event_id, value, gap FROM c WHERE r = 1""")
def nearest_in_time(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    return joins.nearest_in_time(log.where("event_type = 'purchase'"), log.where("event_type = 'view'"), ["user_id"], "ts", "value", "event_id")


@query("""SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
  AND abs(datediff('day', a.o_orderdate, b.o_orderdate)) <= 45 WHERE a.o_orderkey < b.o_orderkey""")
def range_join_45_days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    a = rows.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_orderdate").cast("date").alias("day_a"))
    b = rows.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_orderdate").cast("date").alias("day_b"))
    return joins.within_days(a, b, ["o_custkey"], "day_a", "day_b", 45).where("a < b").select("o_custkey", "a", "b")


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
  SELECT user_id, round(sum(CASE WHEN gap > 0 AND gap <= 7200 THEN gap ELSE 0 END), 3) AS busy, count(*) AS events FROM g GROUP BY 1""")
def busy_seconds(spark, sf_dir):
    rows = islands.busy_seconds(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 7200)
    return rows.withColumn("busy", F.round("busy", 3))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS b FROM events),
  s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, min(ts) AS begins, max(ts) AS ends, count(*) AS events FROM s GROUP BY 1, 2""")
def session_gaps(spark, sf_dir):
    return islands.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 7200)


@query("""WITH w AS (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events)
  SELECT event_type, max(n) AS busiest, count(*) AS events FROM w GROUP BY 1""")
def burst_window(spark, sf_dir):
    return islands.busiest_window(table(spark, sf_dir, "events"), ["event_type"], "ts")


@query("""WITH w AS (SELECT count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type <> 'error')
  SELECT (SELECT count(*) FROM events WHERE event_type <> 'error') AS calls, (SELECT count(*) FROM events WHERE event_type = 'error') AS refusals,
  (SELECT max(n) FROM w) AS busiest, (SELECT max(n) FROM w) >= 60 AS unusual""")
def access_burst(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), (F.col("event_type") != "error").alias("allowed"))
    return islands.burst_of_log(log)


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS events, round(sum(value), 4) AS value FROM events
  GROUP BY ROLLUP (event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10)""")
def json_props_rollup(spark, sf_dir):
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("long") % 10
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    return rows.rollup("event_type", "k").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))


@query("""SELECT quality, toxic, count(*) AS documents FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def verdict_tally(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def verdict_unmatched(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id").join(good, "doc_id", "left_anti")


@query(f"""{WITH}, w AS (SELECT document_id FROM docs WHERE transcribed), d AS (SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_linenumber = 5)
  SELECT w.document_id FROM w WHERE w.document_id NOT IN (SELECT document_id FROM d)""")
def resume_not_done(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("document_id"))
    return compaction.not_done(archive(spark, sf_dir).documents.where("transcribed").select("document_id"), done, ["document_id"])


# ---------------------------------------------------------------- text

FOLDED = "replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '''', '')"
TOKENS = f"t AS (SELECT doc_id AS doc, unnest(list_filter(string_split_regex({FOLDED}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS token FROM documents), p AS (SELECT doc, token, count(*) AS tf FROM t GROUP BY 1, 2)"


def _index(spark, sf_dir):
    return postings(table(spark, sf_dir, "documents"), "doc_id", ["text"])


@query(f"""WITH {TOKENS}, l AS (SELECT doc, sum(tf) AS len FROM p GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS m FROM l),
  f AS (SELECT doc, 'that' AS w, sum(tf) AS tf FROM p WHERE token LIKE 'that%' GROUP BY 1 UNION ALL SELECT doc, 'heon', sum(tf) FROM p WHERE token LIKE 'heon%' GROUP BY 1),
  c AS (SELECT w, count(*) AS k FROM f GROUP BY 1),
  s AS (SELECT doc, w, -greatest(ln((g.n - k + 0.5) / (k + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / g.m)) AS s FROM f JOIN c USING (w) JOIN l USING (doc), g)
  SELECT doc, round(sum(s), 6) AS score FROM s GROUP BY 1 HAVING count(*) = 2""")
def search_bm25(spark, sf_dir):
    lengths = lengths_of(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return hits(_index(spark, sf_dir), "Thát heon", lengths).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS} SELECT count(DISTINCT doc) AS documents FROM p WHERE token LIKE 'ent%'")
def fold_search_count(spark, sf_dir):
    return count_hits(_index(spark, sf_dir), "énT")


@query(f"WITH {TOKENS} SELECT token, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS times FROM p GROUP BY 1")
def vocabulary(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("times"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
  SELECT line, count(*) AS times, count(DISTINCT doc_id) AS documents FROM l WHERE line <> '' GROUP BY 1 HAVING count(*) >= 3""")
def separator_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    once = lines.groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("line").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("documents")).where("times >= 3")


@query("""SELECT doc_id, CAST(s AS BIGINT) AS place, CAST(length(substring(text, CAST(s AS BIGINT) + 1, 2000)) AS BIGINT) AS chars
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 1900)) AS s FROM documents)""")
def sliding_text_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(sliding_windows(F.col("text"), 2000, 100)).alias("w"))
    return rows.select("doc_id", F.col("w.place").cast("long").alias("place"), F.length("w.text").cast("long").alias("chars"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '(?s).{1,500}(?:\\n|\\z)|.{1,500}') AS pages FROM documents),
  k AS (SELECT doc_id, list_filter(pages, lambda x: trim(x) <> '') AS pages FROM d)
  SELECT doc_id, CAST(unnest(range(0, len(pages))) AS INTEGER) AS page, CAST(unnest(list_transform(pages, lambda x: length(x))) AS INTEGER) AS chars FROM k""")
def text_paging(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text_pages(F.col("text"), 500)).alias("page", "text"))
    return rows.select("doc_id", "page", F.length("text").alias("chars"))


@query(f"SELECT doc_id, {FOLDED} AS folded FROM documents")
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("folded"))


@query("""WITH n AS (SELECT page_id, regexp_extract_all(html, '[0-9]+') AS a FROM pages), d AS (SELECT doc_id, text FROM documents)
  SELECT page_id, CAST(len(a) AS BIGINT) AS sent, CAST(len(list_filter(a, lambda x: contains(coalesce(text, ''), x))) AS BIGINT) AS kept FROM n LEFT JOIN d ON page_id = doc_id""")
def page_numbers_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    numbers = F.regexp_extract_all("html", F.lit("[0-9]+"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", numbers.alias("a")).join(docs, F.col("page_id") == F.col("doc_id"), "left")
    kept = F.size(F.filter("a", lambda x: F.contains(F.coalesce("text", F.lit("")), x)))
    return rows.select("page_id", F.size("a").cast("long").alias("sent"), kept.cast("long").alias("kept"))


# ---------------------------------------------------------------- rules and series over printed values

PRINTED = """
SELECT l_orderkey * 10 + l_linenumber AS observation_id, l_orderkey AS document_id, l_linenumber AS page, p_name AS name,
       concat(CASE WHEN l_suppkey % 11 = 0 THEN '< ' ELSE '' END, CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_tax > 0.05 THEN ',5' ELSE '' END) AS value,
       CASE WHEN l_suppkey % 13 = 0 THEN l_quantity + 1 WHEN l_tax > 0.05 THEN l_quantity + 0.5 ELSE l_quantity END AS value_numeric,
       CASE WHEN l_suppkey % 22 = 0 THEN '<' END AS comparator, 'quantitative' AS value_kind,
       CASE WHEN l_discount < 0.02 THEN 'other' ELSE 'result' END AS value_role,
       CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'g/l' ELSE 'mmol/l' END AS unit,
       CASE WHEN l_suppkey % 7 = 0 THEN '40-10' WHEN l_suppkey % 7 = 1 THEN '< 30' WHEN l_suppkey % 7 = 2 THEN 'none' ELSE '10-40 g/l' END AS reference,
       CASE WHEN l_suppkey % 7 = 0 THEN 10.0 WHEN l_suppkey % 7 = 3 THEN 11.0 WHEN l_suppkey % 7 > 3 THEN 10.0 END AS reference_low,
       CASE WHEN l_suppkey % 7 <> 2 THEN CASE WHEN l_suppkey % 7 = 1 THEN 30.0 ELSE 40.0 END END AS reference_high,
       CAST(NULL AS STRING) AS column_heading, concat(p_name, ' line ', CAST(l_linenumber AS STRING)) AS snippet,
       split_part(p_name, ' ', 2) AS indicator_id, CASE WHEN l_returnflag = 'A' THEN 'blood' END AS material, CAST(l_shipdate AS DATE) AS date
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def _printed(spark, sf_dir) -> dict[str, DataFrame]:
    values = bound(spark, sf_dir, PRINTED, "lineitem", "part")
    return {"values": values}


@query(f"""WITH v AS ({PRINTED}), f AS (
  SELECT 'number_differs' AS rule, document_id FROM v WHERE observation_id IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_suppkey % 13 = 0)
    AND value_numeric <> CAST(replace(replace(value, '< ', ''), ',', '.') AS DOUBLE)
  UNION ALL SELECT 'comparator_missing', document_id FROM v WHERE (value LIKE '<%') <> (comparator IS NOT NULL)
  UNION ALL SELECT 'reference_reversed', document_id FROM v WHERE reference = '40-10'
  UNION ALL SELECT 'range_read_two_ways', document_id FROM v WHERE reference = '10-40 g/l' AND reference_low = 11
  UNION ALL SELECT 'row_without_result', document_id FROM (SELECT document_id, page, name FROM v GROUP BY 1, 2, 3 HAVING bool_and(value_role = 'other'))
  UNION ALL SELECT 'repeated_value', document_id FROM (SELECT document_id, unnest(range(1, count(*))) FROM v GROUP BY document_id, page, name, value, unit))
  SELECT rule, count(*) AS findings, count(DISTINCT document_id) AS documents FROM f GROUP BY 1""")
def rule_tally(spark, sf_dir):
    only = ["number_differs", "comparator_missing", "reference_reversed", "range_read_two_ways", "row_without_result", "repeated_value"]
    return rules.tally(rules.run(_printed(spark, sf_dir), only=only))


# Tables on which each of the other rules finds something: values, documents and pages.
VALUES = """
SELECT l_orderkey * 10 + l_linenumber AS observation_id, l_orderkey AS document_id, l_linenumber AS page,
       CASE WHEN l_suppkey % 10 = 1 THEN 'OD' WHEN l_suppkey % 10 = 2 THEN 'Glucose' ELSE p_name END AS name,
       CASE WHEN l_partkey % 10 = 0 THEN 'not seen' WHEN l_partkey % 10 = 1 THEN 'sph 1.5 cyl 2' WHEN l_partkey % 10 = 2 THEN '12 mg'
            WHEN l_partkey % 10 = 3 THEN 'no hemoglobin seen' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS value,
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity * CASE WHEN l_suppkey % 50 = 0 THEN 100 ELSE 1 END END AS value_numeric,
       CASE WHEN l_suppkey % 22 = 0 THEN '<' END AS comparator, CASE WHEN l_tax > 0.07 THEN 'qualitative' ELSE 'quantitative' END AS value_kind,
       CASE WHEN l_discount < 0.02 THEN 'other' ELSE 'result' END AS value_role,
       CASE WHEN l_orderkey % 997 = 1 THEN 'g/dl' WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'g/l' ELSE 'mmol/l' END AS unit,
       CASE WHEN l_suppkey % 10 = 5 THEN '1000-4000' WHEN l_suppkey % 10 = 6 THEN '1-4 g/l' WHEN l_suppkey % 10 > 6 THEN '10-40' END AS reference,
       CASE WHEN l_suppkey % 10 = 4 THEN concat('seen on ', CAST(date_add(CAST(l_shipdate AS DATE), -CAST(l_quantity AS INT)) AS STRING))
            WHEN l_suppkey % 10 IN (1, 3) THEN 'visus 0.5' ELSE p_name END AS snippet,
       CAST(NULL AS STRING) AS column_heading, split_part(p_name, ' ', 2) AS indicator_id, CASE WHEN l_returnflag = 'A' THEN 'blood' END AS material,
       CAST(l_shipdate AS DATE) AS date
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
PAPERS = """
SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'lab_panel' ELSE 'report' END AS doc_type,
       CASE WHEN o_orderkey % 4 = 1 THEN ' ' ELSE 'Form' END AS title, o_totalprice > 50000 AS transcribed,
       CASE WHEN o_custkey % 6 = 0 THEN 'Dr. Anna Smith' WHEN o_custkey % 6 = 1 THEN 'Ivanov I. I.' WHEN o_custkey % 6 = 2 THEN 'Clinic Dr House'
            WHEN o_custkey % 6 = 3 THEN 'Labоratory' ELSE 'Center 5' END AS provider,
       CASE WHEN o_custkey % 11 = 0 THEN 'Smith' END AS institution_was, o_orderkey % 9 = 0 AS flagged, o_orderkey % 13 = 0 AS born
FROM orders
"""
SHEETS = """
SELECT l_orderkey AS document_id, l_linenumber + CASE WHEN l_suppkey % 40 = 0 THEN 100 ELSE 0 END AS page,
       CASE WHEN l_linenumber % 3 = 0 THEN concat(repeat('word ', 50), '5 17') ELSE 'short page with 17' END AS sent,
       CASE WHEN l_orderkey % 5 = 0 THEN ' ' WHEN l_orderkey % 5 = 1 THEN concat(repeat('word ', 10), '17') WHEN l_linenumber % 3 = 0 THEN concat(repeat('word ', 50), '5 17')
            ELSE 'short page with 17' END AS got, l_orderkey % 2 = 0 AS as_text, l_orderkey % 3 = 0 AS tabular
FROM lineitem
"""
LATER = """number_far_from_the_others unit_alone_in_a_series unit_missing_where_others_have_one range_powers_from_the_rest two-scales-in-one-test unit_from_range
value_quoted_from_another_study one_scale_for_a_test unit_by_numbers quantitative_without_number named_after_the_eye several_measurements_in_one_value date_to_check
unreadable_parts unreadable_on_images institution_looks_like_a_name lab_form_without_a_title value_names_another_test page_text_missing page_text_short
table_page_without_values provider_reads_like_a_person word_in_two_alphabets value_not_on_the_page value_not_in_page_text value_not_in_own_page_text
reference_not_in_page_text reference_not_in_own_page_text letters_in_numeric_value_on_image comparator_not_printed no_column_headings_in_multi_value_rows
document_date_is_birth_date""".split()
_DUCK_VALUES = VALUES.replace("date_add(CAST(l_shipdate AS DATE), -CAST(l_quantity AS INT))", "CAST(l_shipdate AS DATE) - CAST(l_quantity AS INT)")


@query(f"""WITH v AS ({_DUCK_VALUES}), d AS ({PAPERS}), p AS ({SHEETS}),
  res AS (SELECT * FROM v WHERE value_role = 'result'), positive AS (SELECT * FROM res WHERE value_numeric > 0),
  med AS (SELECT indicator_id AS i, coalesce(unit, '') AS u, coalesce(material, '') AS m, median(value_numeric) AS middle, count(*) AS n FROM positive GROUP BY 1, 2, 3),
  habit AS (SELECT indicator_id AS i, unit AS u, count(*) AS n FROM v WHERE unit IS NOT NULL GROUP BY 1, 2), habits AS (SELECT *, sum(n) OVER (PARTITION BY i) AS every FROM habit),
  band AS (SELECT *, CASE reference WHEN '1000-4000' THEN log10(2000) WHEN '1-4 g/l' THEN log10(2) WHEN '10-40' THEN log10(20) END AS mid FROM v WHERE reference IS NOT NULL),
  usual AS (SELECT indicator_id AS i, coalesce(unit, '') AS u, median(mid) AS usual, count(*) AS n FROM band GROUP BY 1, 2 HAVING count(*) >= 2),
  away AS (SELECT *, abs(mid - (SELECT median(b.mid) FROM band b WHERE b.indicator_id = band.indicator_id)) >= 1.5 AS far FROM band),
  agreed AS (SELECT indicator_id AS i FROM away GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN far THEN 0.0 ELSE 1.0 END) >= 0.75),
  spread AS (SELECT indicator_id AS i, coalesce(material, '') AS m, unit AS u, min(value_numeric) AS low, max(value_numeric) AS high FROM positive WHERE unit IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  fits AS (SELECT observation_id FROM positive JOIN spread ON indicator_id = i AND coalesce(material, '') = m WHERE unit IS NULL AND value_numeric * 2 >= low AND value_numeric <= high * 2 GROUP BY 1 HAVING count(*) = 1),
  told AS (SELECT *, CASE WHEN l = 0 THEN [] WHEN l = 1 THEN ['1.5', '2'] WHEN l = 2 THEN ['12'] WHEN l = 3 THEN [] ELSE [value] END AS tokens,
     CASE reference WHEN '1000-4000' THEN ['1000', '4000'] WHEN '1-4 g/l' THEN ['1', '4'] WHEN '10-40' THEN ['10', '40'] ELSE [] END AS ends
     FROM (SELECT *, CASE value WHEN 'not seen' THEN 0 WHEN 'sph 1.5 cyl 2' THEN 1 WHEN '12 mg' THEN 2 WHEN 'no hemoglobin seen' THEN 3 ELSE 4 END AS l FROM v)),
  met AS (SELECT told.*, sent, replace(got, ' ', '') AS got, replace(sent, ' ', '') AS packed, as_text FROM told JOIN p USING (document_id, page)),
  kept AS (SELECT *, len(list_filter(tokens, lambda x: NOT contains(packed, x))) > 0 AS not_sent, NOT contains(got, replace(value, ' ', '')) AS not_got,
     len(list_filter(ends, lambda x: NOT contains(got, x))) > 0 AS no_ends FROM met WHERE value_kind <> 'qualitative'),
  f AS (
  SELECT 'number_far_from_the_others' AS rule, document_id FROM positive JOIN med ON indicator_id = i AND coalesce(unit, '') = u AND coalesce(material, '') = m WHERE n >= 4 AND (value_numeric >= 10 * middle OR value_numeric * 10 <= middle)
  UNION ALL SELECT 'unit_alone_in_a_series', document_id FROM v JOIN habits ON indicator_id = i AND unit = u WHERE n <= 1 AND every - n >= 10
  UNION ALL SELECT 'unit_missing_where_others_have_one', document_id FROM v WHERE unit IS NULL AND value_numeric IS NOT NULL AND indicator_id IN (SELECT indicator_id FROM v WHERE unit IS NOT NULL AND value_numeric IS NOT NULL GROUP BY 1 HAVING count(*) >= 4)
  UNION ALL SELECT 'range_powers_from_the_rest', document_id FROM away JOIN agreed ON indicator_id = i WHERE far
  UNION ALL SELECT 'two-scales-in-one-test', document_id FROM band JOIN usual ON indicator_id = i AND coalesce(unit, '') = u WHERE round_even(mid - usual, 0) <> 0 AND abs(mid - usual - round_even(mid - usual, 0)) <= log10(1.15)
  UNION ALL SELECT 'unit_from_range', document_id FROM v WHERE unit IS NULL AND reference = '1-4 g/l'
  UNION ALL SELECT 'value_quoted_from_another_study', document_id FROM v WHERE snippet LIKE 'seen on %' AND date - CAST(right(snippet, 10) AS DATE) >= 31
  UNION ALL SELECT 'one_scale_for_a_test', document_id FROM v WHERE name = 'Glucose' AND unit IN ('g/l', 'g/dl')
  UNION ALL SELECT 'unit_by_numbers', document_id FROM v WHERE observation_id IN (SELECT observation_id FROM fits)
  UNION ALL SELECT 'quantitative_without_number', document_id FROM v WHERE value_kind = 'quantitative' AND value IN ('not seen', 'no hemoglobin seen')
  UNION ALL SELECT 'named_after_the_eye', document_id FROM v WHERE name = 'OD'
  UNION ALL SELECT 'several_measurements_in_one_value', document_id FROM v WHERE value = 'sph 1.5 cyl 2'
  UNION ALL SELECT 'date_to_check', document_id FROM d WHERE flagged
  UNION ALL SELECT 'unreadable_parts', document_id FROM p WHERE got = ' '
  UNION ALL SELECT 'unreadable_on_images', document_id FROM p WHERE got = ' ' AND NOT as_text
  UNION ALL SELECT 'institution_looks_like_a_name', document_id FROM d WHERE institution_was IS NOT NULL
  UNION ALL SELECT 'lab_form_without_a_title', document_id FROM d WHERE doc_type = 'lab_panel' AND transcribed AND title = ' '
  UNION ALL SELECT 'value_names_another_test', document_id FROM (SELECT DISTINCT observation_id, document_id FROM v WHERE value = 'no hemoglobin seen')
  UNION ALL SELECT 'page_text_missing', document_id FROM p WHERE length(trim(got)) < 20
  UNION ALL SELECT 'page_text_short', document_id FROM p WHERE sent LIKE 'word%' AND document_id % 5 IN (0, 1)
  UNION ALL SELECT 'table_page_without_values', document_id FROM p JOIN d USING (document_id) WHERE tabular AND doc_type = 'lab_panel' AND page > 100
  UNION ALL SELECT 'provider_reads_like_a_person', document_id FROM d WHERE provider IN ('Dr. Anna Smith', 'Ivanov I. I.')
  UNION ALL SELECT 'word_in_two_alphabets', document_id FROM d WHERE provider LIKE 'Lab%'
  UNION ALL SELECT 'value_not_on_the_page', document_id FROM kept WHERE as_text AND sent LIKE 'word%' AND not_sent
  UNION ALL SELECT 'value_not_in_page_text', document_id FROM kept WHERE as_text AND not_got
  UNION ALL SELECT 'value_not_in_own_page_text', document_id FROM kept WHERE NOT as_text AND not_got
  UNION ALL SELECT 'reference_not_in_page_text', document_id FROM kept WHERE as_text AND no_ends
  UNION ALL SELECT 'reference_not_in_own_page_text', document_id FROM kept WHERE NOT as_text AND no_ends
  UNION ALL SELECT 'letters_in_numeric_value_on_image', document_id FROM met WHERE value_kind = 'quantitative' AND NOT as_text AND l < 4
  UNION ALL SELECT 'comparator_not_printed', document_id FROM v WHERE comparator IS NOT NULL
  UNION ALL SELECT 'no_column_headings_in_multi_value_rows', document_id FROM (SELECT document_id, page, snippet, name FROM v GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'document_date_is_birth_date', document_id FROM d WHERE born)
  SELECT rule, count(*) AS findings, count(DISTINCT document_id) AS documents FROM f GROUP BY 1""")
def rule_findings(spark, sf_dir):
    """The rules that rule_tally has not, with their shipped thresholds, on tables made for them."""
    documents = bound(spark, sf_dir, PAPERS, "orders")
    none = F.array().cast("array<string>")
    documents = documents.withColumn("date_flags", F.when(F.col("flagged"), F.array(F.lit("far"))).otherwise(none))
    documents = documents.withColumn("birth_dates", F.when(F.col("born"), F.array("date")).otherwise(F.array().cast("array<date>")))
    pages = bound(spark, sf_dir, SHEETS, "lineitem")
    tables = {
        "values": bound(spark, sf_dir, VALUES, "lineitem", "part"), "documents": documents, "pages": pages,
        "unreadable": pages.where("trim(got) = ''").select("document_id", "page"),
        "indicators": spark.createDataFrame([("blood colour", "Hemoglobin"), ("short", "seen")], "indicator_id string, spelling string"),
    }
    return rules.tally(rules.run(tables, only=LATER))


@query(f"""WITH v AS ({PRINTED}), s AS (SELECT *, CASE WHEN unit IS NOT NULL THEN unit WHEN reference = '10-40 g/l' THEN 'g/l' ELSE '' END AS scale,
    CASE WHEN reference = '10-40 g/l' THEN 10.0 END AS lo, CASE reference WHEN '10-40 g/l' THEN 40.0 WHEN '< 30' THEN 30.0 END AS hi FROM v),
  n AS (SELECT indicator_id AS i, material AS m, scale AS s, min(value_numeric) AS least, max(value_numeric) AS most, median(value_numeric) AS middle, count(*) AS n, min(date) AS since FROM s GROUP BY 1, 2, 3),
  b AS (SELECT indicator_id AS i, material AS m, min(lo) AS low, max(hi) AS high, min(value_numeric) AS lo, max(value_numeric) AS hi FROM s WHERE scale = '' GROUP BY 1, 2),
  f AS (SELECT b.i, b.m, n.s, CASE WHEN high IS NOT NULL THEN most <= 2 * high AND greatest(high, most) <= 2 * least(high, most) ELSE greatest(b.lo, least) <= 2 * least(b.lo, least) AND greatest(b.hi, most) <= 2 * least(b.hi, most) END AS fits
     FROM b JOIN n ON b.i = n.i AND b.m IS NOT DISTINCT FROM n.m AND n.s <> '' AND n.n >= 2),
  o AS (SELECT i, m, min(s) AS s FROM f WHERE fits GROUP BY 1, 2 HAVING count(*) = 1),
  p AS (SELECT v.*, CASE WHEN v.scale = '' THEN coalesce(o.s, '') ELSE v.scale END AS spot FROM s v LEFT JOIN o ON o.i = v.indicator_id AND o.m IS NOT DISTINCT FROM v.material),
  t AS (SELECT indicator_id AS i, material AS m, spot, median(value_numeric) AS middle, count(*) AS n, min(date) AS since FROM p GROUP BY 1, 2, 3),
  j AS (SELECT x.i, x.m, x.spot, coalesce(arg_min(y.spot, (epoch(y.since), y.spot)) FILTER (y.n >= 2 AND x.n >= 2 AND greatest(x.middle, y.middle) <= 2 * least(x.middle, y.middle) AND (y.since, y.spot) < (x.since, x.spot) AND x.spot <> ''), x.spot) AS series
     FROM t x LEFT JOIN t y ON x.i = y.i AND x.m IS NOT DISTINCT FROM y.m AND y.spot <> '' GROUP BY x.i, x.m, x.spot),
  w AS (SELECT p.*, series FROM p JOIN j ON j.i = p.indicator_id AND j.m IS NOT DISTINCT FROM p.material AND j.spot = p.spot)
  SELECT observation_id, indicator_id, material, series, date, value_numeric AS number, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, CAST(0 AS INT) AS moved, CAST(0 AS BIGINT) AS retold, CAST(NULL AS VARCHAR) AS why,
         row_number() OVER (PARTITION BY indicator_id, material, series ORDER BY date, document_id, observation_id, value_numeric, lo NULLS FIRST, hi NULLS FIRST) AS place FROM w""")
def series_charts(spark, sf_dir):
    values = _printed(spark, sf_dir)["values"].drop("page", "value", "comparator", "value_kind", "value_role", "reference_low", "reference_high", "column_heading")
    out = series.charts(values, without=("name", "unit", "reference", "snippet"))
    return out.select("observation_id", "indicator_id", "material", "series", "date", "number", "low", "high", "moved", "retold", "why", "place")


@query(f"""{WITH}, p AS (SELECT name, value_numeric FROM obs) SELECT DISTINCT name, lower(name) AS folded FROM p""")
def name_folds(spark, sf_dir):
    return archive(spark, sf_dir).observations.select("name").distinct().select("name", fold(F.col("name")).alias("folded"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, split_part(name, ' ', 1) AS a, split_part(name, ' ', 2) AS b FROM n),
  e AS (SELECT x.name AS x, y.name AS y FROM w x JOIN w y ON x.b = y.b AND length(x.a) = length(y.a) WHERE x.name <> y.name),
  r AS (SELECT DISTINCT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def name_families(spark, sf_dir):
    """Names that share their last word and the length of the first, joined into families."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    keyed = n.withColumn("key", F.concat_ws(" ", F.length(F.split("name", " ")[0]), F.split("name", " ")[1]))
    first = keyed.groupBy("key").agg(F.min("name").alias("a"))
    return graph.components(keyed.join(first, "key").where("name <> a").select("a", F.col("name").alias("b")))


# ---------------------------------------------------------------- composed views


@query(f"""{WITH} SELECT document_id, page, name, value_numeric, min(observation_id) AS observation_id, min(date) AS date FROM obs JOIN docs USING (document_id)
  WHERE primary_copy AND (lower(name) LIKE '%ring%' OR indicator_id = 'gear') GROUP BY 1, 2, 3, 4""")
def value_history(spark, sf_dir):
    return views.value_history(archive(spark, sf_dir), "ring", ["gear"])


@query(f"{WITH} SELECT indicator_id, unit, count(*) AS values FROM obs JOIN docs USING (document_id) WHERE primary_copy AND {IS_RESULT} GROUP BY 1, 2")
def unit_habits(spark, sf_dir):
    return views.unit_habits(archive(spark, sf_dir))


@query(f"""{WITH} SELECT doc_type, language, document_id FROM docs QUALIFY
  row_number() OVER (PARTITION BY doc_type, language ORDER BY md5(CAST(document_id AS VARCHAR)), document_id) <= 3""")
def sample_documents(spark, sf_dir):
    rows = archive(spark, sf_dir).documents.select("doc_type", "language", "document_id")
    return views.sample_of_strata(rows, ["doc_type", "language"], "document_id", 3)


@query(f"""{WITH}, f AS (SELECT document_id, count(*) AS found FROM obs WHERE trim(coalesce(flag, '')) <> '' GROUP BY 1)
  SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS documents, CAST(100 * count(*) FILTER (WHERE transcribed) // count(*) AS INTEGER) AS percent,
  CAST(coalesce(sum(found), 0) AS BIGINT) AS findings FROM docs LEFT JOIN f USING (document_id) GROUP BY 1""")
def source_documents(spark, sf_dir):
    a = archive(spark, sf_dir)
    return views.source_documents(a.documents, a.observations.where("trim(coalesce(flag, '')) <> ''").select("document_id"))


ACCESS = "SELECT CASE WHEN user_id % 3 = 0 THEN 'open' ELSE 'guarded' END AS door, event_type AS tool, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS repeats FROM events"


@query(f"WITH a AS ({ACCESS}) SELECT door, tool, count(*) AS lines, CAST(sum(1 + coalesce(repeats, 0)) AS BIGINT) AS calls FROM a GROUP BY 1, 2")
def access_counts(spark, sf_dir):
    return views.access_counts(bound(spark, sf_dir, ACCESS, "events"))


#: Groups of spellings: the names of a test, but for one test that nobody has grouped.
GROUPS = "SELECT DISTINCT split_part(p_name, ' ', 2) AS label, p_name AS name FROM part WHERE split_part(p_name, ' ', 2) <> 'gear'"
PRINTED_NAMES = "SELECT p_name AS name, count(*) AS values FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name"
VERDICTS = "SELECT CASE WHEN p_name LIKE 'large%' THEN 'settled apart' ELSE split_part(p_name, ' ', 2) END AS label, p_name AS name FROM part"
# A form of one piece names the part; other forms name nothing.
SOURCES = "SELECT l_suppkey AS source, CASE WHEN l_quantity = 1 THEN concat(p_name, ' ', CAST(p_partkey AS STRING)) END AS name FROM lineitem JOIN part ON l_partkey = p_partkey"
CARRIED = "SELECT concat(p_brand, ' ', CAST(p_partkey AS STRING)) AS label, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name FROM part"


@query(f"""WITH g AS ({GROUPS}), p AS ({PRINTED_NAMES}) SELECT label, count(*) AS names, count(p.name) AS used, CAST(coalesce(sum(values), 0) AS BIGINT) AS values
  FROM g LEFT JOIN p ON g.name = p.name GROUP BY 1""")
def group_uses(spark, sf_dir):
    return views.group_uses(bound(spark, sf_dir, GROUPS, "part"), bound(spark, sf_dir, PRINTED_NAMES, "lineitem", "part"))


@query(f"WITH g AS ({GROUPS}), p AS ({PRINTED_NAMES}) SELECT name, values FROM p WHERE name NOT IN (SELECT name FROM g)")
def names_without_group(spark, sf_dir):
    return views.names_without_group(bound(spark, sf_dir, GROUPS, "part"), bound(spark, sf_dir, PRINTED_NAMES, "lineitem", "part"))


@query(f"""WITH g AS ({GROUPS}), v AS ({VERDICTS}), d AS (SELECT label, count(*) AS names, string_agg(name, '+' ORDER BY name) AS all_names FROM g GROUP BY 1),
  w AS (SELECT label, string_agg(DISTINCT name, '+' ORDER BY name) AS all_names FROM v GROUP BY 1)
  SELECT d.label, d.names FROM d LEFT JOIN w ON d.label = w.label WHERE d.names > 1 AND d.all_names IS DISTINCT FROM w.all_names""")
def groups_to_reread(spark, sf_dir):
    return views.groups_to_reread(bound(spark, sf_dir, GROUPS, "part"), views.digests(bound(spark, sf_dir, VERDICTS, "part")))


@query(f"""WITH g AS ({CARRIED}), s AS ({SOURCES}), b AS (SELECT label, count(DISTINCT source) AS sources FROM g LEFT JOIN s ON g.name = s.name GROUP BY 1)
  SELECT label, CASE WHEN sources = 0 THEN 'left' WHEN sources = 1 THEN 'settled' ELSE 'proposed' END AS fate, sources FROM b""")
def carried_joins(spark, sf_dir):
    return views.carried_joins(bound(spark, sf_dir, CARRIED, "part"), bound(spark, sf_dir, SOURCES, "lineitem", "part"))


PAGES = "SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page FROM lineitem"
CLASSIFIED = "SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page FROM lineitem WHERE l_tax < 0.06"
READ = f"docs AS ({DOCUMENTS}), p AS ({PAGES}), c AS ({CLASSIFIED}), r AS (SELECT document_id FROM docs WHERE transcribed)"


def _pages(spark, sf_dir):
    return bound(spark, sf_dir, PAGES, "lineitem"), bound(spark, sf_dir, CLASSIFIED, "lineitem"), archive(spark, sf_dir).documents.where("transcribed")


@query(f"""WITH {READ} SELECT document_id, page FROM p WHERE (document_id, page) NOT IN (SELECT (document_id, page) FROM c) OR document_id NOT IN (SELECT document_id FROM r)""")
def left_to_send(spark, sf_dir):
    return views.left_to_send(*_pages(spark, sf_dir))


@query(f"""WITH {READ} SELECT page, count(*) AS wanted, count(c.page) AS done, CAST(100 * count(c.page) // count(*) AS INTEGER) AS percent
  FROM p LEFT JOIN c USING (document_id, page) GROUP BY page""")
def percent_done(spark, sf_dir):
    pages, classified, _ = _pages(spark, sf_dir)
    return views.percent_done(pages, classified, ["document_id", "page"], "page")


@query(f"""WITH {READ} SELECT 'files' AS grain, count(*) AS "left" FROM docs WHERE document_id NOT IN (SELECT document_id FROM p)
  UNION ALL SELECT 'pages', count(*) FROM p WHERE (document_id, page) NOT IN (SELECT (document_id, page) FROM c)
  UNION ALL SELECT 'documents', count(*) FROM docs WHERE document_id NOT IN (SELECT document_id FROM r)""")
def left_uncovered(spark, sf_dir):
    pages, classified, read = _pages(spark, sf_dir)
    documents = archive(spark, sf_dir).documents.select("document_id", F.col("document_id").alias("file"))
    named = [x.withColumnRenamed("document_id", "file") for x in (pages, classified)]
    return reading.coverage(documents, named[0], documents, named[1], read)


FILES = """SELECT coalesce(lang, 'other') AS category, n_chars AS size, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 END AS parts,
  CASE WHEN text IS NULL OR text = '' THEN 'nothing in it' END AS error, CASE WHEN doc_id % 11 = 0 THEN 'system file' END AS skipped FROM documents"""


@query(f"""WITH f AS ({FILES}) SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(parts), 0) AS BIGINT) AS parts,
  count(error) AS errors, count(skipped) AS skipped FROM f GROUP BY 1""")
def inventory_summary(spark, sf_dir):
    return reading.inventory_summary(bound(spark, sf_dir, FILES, "documents"))


LINES = """SELECT l_orderkey AS file, l_linenumber AS page, CAST(l_quantity AS BIGINT) AS lines,
  CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_tax < 0.06 THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 3 END AS unreadable FROM lineitem"""


@query(f"""WITH l AS ({LINES}), m AS (SELECT file, avg(lines / (lines + unreadable)) AS share FROM l GROUP BY 1)
  SELECT file, CAST(CASE WHEN share = 1 THEN 100 ELSE least(floor(share * 100), 99) END AS INTEGER) AS percent FROM m""")
def file_reading(spark, sf_dir):
    return reading.file_reading(bound(spark, sf_dir, LINES, "lineitem"))


RUNS = """SELECT l_suppkey % 20 AS run, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS text_pages, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS image_pages,
  CAST(15 * count(CASE WHEN l_returnflag = 'N' THEN 1 END) + 127 * count(CASE WHEN l_returnflag <> 'N' THEN 1 END) + l_suppkey % 20 AS BIGINT) AS seconds FROM lineitem GROUP BY l_suppkey % 20"""


@query(f"""WITH r AS ({RUNS}), s AS (SELECT CAST(sum(text_pages * text_pages) AS DOUBLE) AS xx, CAST(sum(text_pages * image_pages) AS DOUBLE) AS xy, CAST(sum(image_pages * image_pages) AS DOUBLE) AS yy,
    CAST(sum(text_pages * seconds) AS DOUBLE) AS xs, CAST(sum(image_pages * seconds) AS DOUBLE) AS ys FROM r)
  SELECT round((xs * yy - ys * xy) / (xx * yy - xy * xy), 6) AS text_price, round((ys * xx - xs * xy) / (xx * yy - xy * xy), 6) AS image_price FROM s""")
def reading_prices(spark, sf_dir):
    out = reading.reading_prices(bound(spark, sf_dir, RUNS, "lineitem"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""{WITH}, a AS (SELECT doc_type AS fact, provider AS answer, document_id, date FROM docs WHERE doc_type IS NOT NULL AND provider <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_type, provider ORDER BY date DESC NULLS LAST, document_id) = 1)
  SELECT fact, answer, document_id, date, count(*) OVER (PARTITION BY fact) AS answers FROM a
  QUALIFY row_number() OVER (PARTITION BY fact ORDER BY date DESC NULLS LAST, document_id, answer) <= 8""")
def newest_answers(spark, sf_dir):
    d = archive(spark, sf_dir).documents.where("doc_type IS NOT NULL AND provider <> ''")
    rows = d.select(F.col("doc_type").alias("fact"), F.col("provider").alias("answer"), "document_id", "date")
    return people.facts(rows).select("fact", "answer", "document_id", "date", "answers")


@query(f"""{WITH}, n AS (SELECT title, document_id FROM docs QUALIFY row_number() OVER (PARTITION BY title ORDER BY date DESC NULLS LAST, document_id) = 1)
  SELECT d.title AS text, count(*) AS times, min(date) AS first_date, max(date) AS last_date, any_value(n.document_id) AS newest_document
  FROM docs d JOIN n ON d.title IS NOT DISTINCT FROM n.title GROUP BY 1""")
def roll_of_titles(spark, sf_dir):
    return people.roll(archive(spark, sf_dir).documents, "title")


MIXED_UP = f"SELECT document_id, CASE WHEN document_id % 4 = 0 THEN coalesce(doctor, provider) ELSE provider END AS provider, CASE WHEN document_id % 8 <> 0 THEN doctor END AS doctor FROM ({DOCUMENTS}) AS d"


@query(f"""WITH m AS ({MIXED_UP}) SELECT document_id, CASE WHEN provider LIKE 'Dr %' THEN NULL ELSE provider END AS provider,
  CASE WHEN provider LIKE 'Dr %' THEN coalesce(doctor, provider) ELSE doctor END AS doctor, CASE WHEN provider LIKE 'Dr %' THEN provider END AS institution_was FROM m""")
def institutions_moved(spark, sf_dir):
    return people.institution_and_doctor(bound(spark, sf_dir, MIXED_UP, "orders"))


SPELLINGS = "SELECT p_name AS name FROM part UNION SELECT concat(p_name, ' ', lower(p_type)) AS name FROM part"


@query(f"""WITH n AS (SELECT name, string_split(name, ' ') AS w FROM ({SPELLINGS}) t)
  SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name <> y.name AND len(x.w) < len(y.w) AND list_has_all(y.w, x.w)""")
def joinable_names(spark, sf_dir):
    return people.worth_joining(bound(spark, sf_dir, SPELLINGS, "part"))


_ORDER = {r: n + 1 for n, r in enumerate(rules.REGISTRY)}


@query(f"""WITH v AS ({PRINTED}), f AS (SELECT DISTINCT document_id, {_ORDER['comparator_missing']} AS o, 'comparator_missing' AS rule FROM v WHERE (value LIKE '<%') <> (comparator IS NOT NULL)
    UNION SELECT document_id, {_ORDER['reference_reversed']}, 'reference_reversed' FROM v WHERE reference = '40-10'
    UNION SELECT document_id, {_ORDER['range_read_two_ways']}, 'range_read_two_ways' FROM v WHERE reference = '10-40 g/l' AND reference_low = 11)
  SELECT document_id, string_agg(rule, ',' ORDER BY o) AS codes, CAST(min(o) AS BIGINT) AS best FROM f GROUP BY 1""")
def documents_to_check(spark, sf_dir):
    found = rules.run(_printed(spark, sf_dir), only=["comparator_missing", "reference_reversed", "range_read_two_ways"])
    return rules.to_check(found).select("document_id", F.array_join("codes", ",").alias("codes"), F.col("best").cast("long").alias("best"))


# ---------------------------------------------------------------- streams, run to their end


def _stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    if all(f.endswith("/events.parquet") for f in batch.inputFiles()):  # a single file, which a stream finds by its folder
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(path)


def _finished(stream: DataFrame) -> DataFrame:
    """What a stream writes until its input is used up, by a file sink in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stream_to_the_end(spark, sf_dir) -> DataFrame:
    """The stream, and in it one event of nobody a day after all others: the watermark then closes every group."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    closing = batch.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    closing.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in batch.schema]).write.parquet(folder)
    return _stream(spark, sf_dir).unionByName(spark.readStream.schema(batch.schema).parquet(folder))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS begins, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = _finished(streams.tumbling(_stream_to_the_end(spark, sf_dir), "ts", "6 hours", "event_type", "value"))
    return out.where("event_type is not null").select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "events", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS b FROM events),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
  SELECT user_id, min(ts) AS begins, count(*) AS events FROM s GROUP BY user_id, session""")
def stream_session(spark, sf_dir):
    out = _finished(streams.sessions(_stream_to_the_end(spark, sf_dir), "ts", "2 hours", "user_id"))
    return out.where("user_id is not null").select("user_id", F.col("begins").cast("timestamp_ntz").alias("begins"), "events")


@query("SELECT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    """Each event once, though the stream brings every one of them twice."""
    twice = _stream(spark, sf_dir).unionByName(_stream(spark, sf_dir))
    return _finished(streams.first_of_key(twice, ["event_id"], "ts")).select("event_id", "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
  r AS (SELECT user_id, ts, k, 0::BIGINT AS repeats FROM e WHERE k = 1
    UNION ALL SELECT n.user_id, n.ts, n.k, n.k - r.k - 1 FROM r, LATERAL (SELECT user_id, ts, k FROM e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 12 HOURS ORDER BY k LIMIT 1) n)
  SELECT user_id, ts AS at, repeats FROM r""")
def stream_throttled(spark, sf_dir):
    """A user's first event, then silence for half a day; how many were held back; state that expires."""
    out = _finished(expiring.throttled(_stream(spark, sf_dir), "user_id", "ts", quiet=12 * 3600, keep=90 * 86_400))
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "repeats")


@query("""WITH e AS (SELECT user_id, ts, event_type = 'purchase' AS ok, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rights FROM events),
  g AS (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id, rights ORDER BY ts) > INTERVAL 3 DAYS, FALSE))::INT AS b FROM e WHERE NOT ok),
  i AS (SELECT *, sum(b) OVER (PARTITION BY user_id, rights ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, rights, island ORDER BY ts) AS nth FROM i)
  SELECT user_id, ts AS at, CASE nth // 2 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 15 END AS minutes, TRUE AS as_in_batch FROM n WHERE nth % 2 = 0""")
def stream_waits(spark, sf_dir):
    """Waits that grow with every second event that is no purchase; state that expires; and the same by windows."""
    rules = {"run": 2, "quiet_minutes": 3 * 24 * 60}
    bought = _stream(spark, sf_dir).withColumn("right", F.col("event_type") == "purchase")
    out = _finished(expiring.waiting(bought, "user_id", "ts", "right", **rules))
    log = table(spark, sf_dir, "events").withColumn("right", F.col("event_type") == "purchase")
    twin = expiring.waits_of_log(log, "user_id", "ts", "right", **rules).select("user_id", F.col("ts").alias("at"), "minutes", F.lit(True).alias("as_in_batch"))
    stream = out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "minutes")
    same = twin.withColumn("at", F.col("at").cast("timestamp_ntz"))
    return stream.join(same, ["user_id", "at", "minutes"], "full").select("user_id", "at", "minutes", F.coalesce("as_in_batch", F.lit(False)).alias("as_in_batch"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_latest(spark, sf_dir):
    """Last-wins state kept by a foreachBatch sink: deltas under a manifest."""
    base = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    sink = streams.keep_latest(spark, f"{base}/out", ["user_id"], "event_id")
    log = _stream(spark, sf_dir).select("user_id", "event_id")
    log.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return Store(spark, f"{base}/out", ["user_id"], "event_id").read().select("user_id", "event_id")


@query("""WITH n AS (SELECT *, ntile(4) OVER (ORDER BY event_id) AS part FROM events), v AS (SELECT unnest([1, 2, 4]) AS version)
  SELECT version, user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM n JOIN v ON part <= version GROUP BY 1, 2""")
def store_versions(spark, sf_dir):
    """A store after its first, second and fourth change: deltas merged on read, a base once they outgrow it, and
    each version still readable."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    edges = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", ["user_id"], "event_id", outgrown=0.9)
    bounds = [float("-inf"), *edges, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        store.commit(events.where((F.col("event_id") > low) & (F.col("event_id") <= high)))
    out = [store.read(v).select(F.lit(v).alias("version"), "user_id", "event_id", "event_type") for v in (1, 2, 4)]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- units and scales

# Spellings of units, and the key that each has; a printed unit is dealt to each row by its number.
UNITS_PRINTED = [
    ("Г/л", "10^9/l"), ("G/L", "10^9/l"), ("10⁹/л", "10^9/l"), ("10*9/л", "10^9/l"), ("x10^9/L", "10^9/l"), ("10E9/L", "10^9/l"), ("Т/л", "10^12/l"),
    ("10¹²/л", "10^12/l"), ("г/л", "g/l"), ("g/L", "g/l"), ("МГ/Л", "mg/l"), ("мкг/л", "ug/l"), ("µg/L", "ug/l"), ("мкмоль/л", "umol/l"),
    ("мкмoль/л", "umol/l"), ("umol/L", "umol/l"), ("ммоль/л", "mmol/l"), ("mM/l", "mmol/l"), ("мм/л", "mmol/l"), ("МЕ/л", "u/l"), ("IU/L", "u/l"),
    ("Од/л", "u/l"), ("UI/L", "u/l"), ("мкМЕ/мл", "uu/ml"), ("µIU/mL", "uu/ml"), ("мМО/л", "mu/l"), ("уд/мин", "/min"), ("уд в 1 хв", "/min"),
    ("bpm", "/min"), ("мин", "min"), ("мм/год", "mm/h"), ("mm/hora", "mm/h"), ("в п/зр", "hpf"), ("кл/мкл", "/ul"), ("клітин/мкл", "/ul"),
    ("10³/мм³", "10^3/ul"), ("UFC/mL", "cfu/ml"), ("°С", "°c"), ("г/1", "g/l"), ("нг\\мл", "ng/ml"), (" ", None),
]
_UNIT_ROWS = ", ".join(f"({k}, '{a}', {'NULL' if b is None else chr(39) + b + chr(39)})" for k, (a, b) in enumerate(UNITS_PRINTED))


@query(f"""WITH u(k, printed, key) AS (VALUES {_UNIT_ROWS}), v AS (SELECT (l_partkey + l_linenumber) % {len(UNITS_PRINTED)} AS k, l_quantity FROM lineitem)
  SELECT key, count(DISTINCT printed) AS spellings, count(*) AS "values", round(sum(l_quantity), 2) AS total FROM v JOIN u USING (k) GROUP BY 1""")
def unit_keys(spark, sf_dir):
    """Printed units brought to one key, in a table whose rows print them in many ways."""
    printed = F.get(F.array(*[F.lit(a) for a, _ in UNITS_PRINTED]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(UNITS_PRINTED)).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(printed.alias("printed"), "l_quantity")
    read = on_distinct(rows, ["printed"], lambda u: {"key": unit_key(u)}, "key string", "unit_")
    return read.groupBy(F.col("unit_key").alias("key")).agg(
        F.countDistinct("printed").alias("spellings"), F.count(F.lit(1)).alias("values"), F.round(F.sum("l_quantity"), 2).alias("total")
    )


# Printed ranges, and the unit that each names.
RANGES_PRINTED = [
    ("53-115 мкмоль/л", "umol/l"), ("0,01-0,08 x10 9 /л", "10^9/l"), ("4-9 Г/л", "10^9/l"), ("10-20 МГ/Л", "mg/l"), ("19,0-37,0%", "%"), ("3-5 мг%", "mg/dl"),
    ("19 - 37 % 1,200 - 3,000*10⁹/л", None), ("до 5", None), ("0-5 IU/L", "u/l"), ("г/л", None), ("4.5-11 10^9/L", "10^9/l"), ("< 5 нг/мл", "ng/ml"),
]
_RANGE_ROWS = ", ".join(f"({k}, '{a}', {'NULL' if b is None else chr(39) + b + chr(39)})" for k, (a, b) in enumerate(RANGES_PRINTED))


@query(f"""WITH u(k, printed, unit) AS (VALUES {_RANGE_ROWS}), v AS (SELECT (l_suppkey + l_linenumber) % {len(RANGES_PRINTED)} AS k FROM lineitem)
  SELECT unit, count(DISTINCT printed) AS ranges, count(*) AS "values" FROM v JOIN u USING (k) GROUP BY 1""")
def units_of_ranges(spark, sf_dir):
    printed = F.get(F.array(*[F.lit(a) for a, _ in RANGES_PRINTED]), ((F.col("l_suppkey") + F.col("l_linenumber")) % len(RANGES_PRINTED)).cast("int"))
    read = on_distinct(table(spark, sf_dir, "lineitem").select(printed.alias("printed")), ["printed"], lambda r: {"unit": unit_of_range(r)}, "unit string", "r_")
    return read.groupBy(F.col("r_unit").alias("unit")).agg(F.countDistinct("printed").alias("ranges"), F.count(F.lit(1)).alias("values"))


# A test is a part's type; some forms print it a hundredfold, range and number or one of them; every fifth test has ranges of no common scale.
SCALED = """
SELECT l_orderkey, l_linenumber, p_type AS test,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_quantity * CASE WHEN l_suppkey % 10 < 3 THEN 100.0 ELSE 1.0 END END AS number,
       CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CASE WHEN p_size % 5 = 0 AND l_linenumber = 1 THEN 3.0 ELSE 5.0 END * CASE WHEN l_suppkey % 10 < 4 THEN 100.0 ELSE 1.0 END END AS low,
       CASE WHEN l_suppkey % 4 = 1 THEN NULL ELSE 60.0 * CASE WHEN l_suppkey % 10 < 4 THEN 100.0 ELSE 1.0 END END AS high
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


@query(f"""WITH r AS ({SCALED}), m AS (SELECT *, CASE WHEN low > 0 AND high > 0 THEN log10(sqrt(low * high)) END AS middle FROM r),
  a AS (SELECT *, min(middle) OVER t AS least, count(middle) OVER t AS n FROM m WINDOW t AS (PARTITION BY test)),
  p AS (SELECT *, CAST(round_even(middle - least, 0) AS INT) AS power FROM a),
  s AS (SELECT test AS t, max(abs(middle - least - power)) AS off, list_sort(list(DISTINCT power) FILTER (power IS NOT NULL)) AS scales FROM p GROUP BY test),
  o AS (SELECT *, n >= 2 AND off <= 0.15 AND len(scales) > 1 AS two FROM p JOIN s ON test = t),
  w AS (SELECT *, CASE WHEN two THEN CASE WHEN power IS NOT NULL AND (number IS NULL OR number BETWEEN low AND high) THEN power
     WHEN number > 0 THEN list_sort(list_transform(scales, lambda x: [abs(log10(number) - least - x), x]))[1][2]::INT END END AS own FROM o),
  c AS (SELECT test, own, count(*) AS times FROM w WHERE own IS NOT NULL GROUP BY 1, 2),
  u AS (SELECT test AS t2, arg_max(own, times * 1000 - own) AS usual FROM c GROUP BY 1)
  SELECT l_orderkey, l_linenumber, CAST(coalesce(CASE WHEN two THEN usual - own END, 0) AS INT) AS moved, CAST(coalesce(CASE WHEN two THEN usual - power END, 0) AS INT) AS band_moved
  FROM w LEFT JOIN u ON test = t2""")
def one_scale(spark, sf_dir):
    """By how many powers of ten a value and its range move to the scale that most of their test are printed at."""
    rows = bound(spark, sf_dir, SCALED, "lineitem", "part")
    return onto_one_scale(rows, ["test"]).select("l_orderkey", "l_linenumber", "moved", "band_moved")


# ---------------------------------------------------------------- addresses, persons, headings, pages of search


@query("""SELECT p_partkey, regexp_replace(lower(concat(p_name, '-', p_brand)), '[^a-z0-9]+', '-', 'g') AS latin, replace(regexp_replace(lower(p_name), '[^a-z]+', '-', 'g'), 'red', 'chervonyi') AS other FROM part""")
def addresses(spark, sf_dir):
    """Names as addresses: Latin ones, and the same with a word in another alphabet."""
    rows = table(spark, sf_dir, "part")
    mixed = F.regexp_replace(F.upper("p_name"), "RED", "Червоний")
    return rows.select("p_partkey", address(F.concat_ws("-", "p_name", "p_brand")).alias("latin"), F.replace(address(mixed), F.lit("chervonyy"), F.lit("chervonyi")).alias("other"))


BORN = """
SELECT o_orderkey, concat('Patient: X', chr(10), CASE WHEN o_custkey % 5 = 0 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'Date of birth:')
         WHEN o_custkey % 5 = 1 THEN concat('Дата рождения: ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' Возраст: 40')
         WHEN o_custkey % 5 = 2 THEN concat('Год рождения ', substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END,
       chr(10), CASE WHEN o_custkey % 4 = 0 THEN 'Sex: F   Age: 73' WHEN o_custkey % 4 = 1 THEN 'Стать: чоловіча' WHEN o_custkey % 4 = 2 THEN 'полость М' ELSE 'Пол - Ж, sexo: M' END) AS text
FROM orders
"""


@query(f"""WITH t AS ({BORN.replace('SELECT o_orderkey,', 'SELECT o_orderkey, o_custkey, o_orderdate,')}) SELECT o_orderkey,
  CASE WHEN o_custkey % 5 < 2 THEN CAST(o_orderdate AS DATE) WHEN o_custkey % 5 = 2 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS born,
  CASE o_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN '' ELSE 'female,male' END AS sex, false AS disagree FROM t""")
def persons_printed(spark, sf_dir):
    """Date of birth and sex as pages print them, in front of a label or after it."""
    rows = bound(spark, sf_dir, BORN, "orders").withColumn("dates", birth_dates(F.col("text")))
    return rows.select("o_orderkey", F.get("dates", F.lit(0)).alias("born"), F.array_join(sex_printed(F.col("text")), ",").alias("sex"), dates_disagree(F.col("dates")).alias("disagree"))


HEADED = """
SELECT l_orderkey AS document_id, concat(upper(p_name), ' ', CASE WHEN l_returnflag = 'A' THEN 'mmol/l' ELSE '' END) AS heading,
       CASE WHEN length(p_name) > 8 THEN CASE WHEN l_linestatus = 'F' THEN 'Кровь' ELSE 'urine' END ELSE p_brand END AS name
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


@query(f"""WITH h AS ({HEADED}), s AS (SELECT trim(heading) AS heading FROM h GROUP BY 1 HAVING bool_and(name IN ('Кровь', 'urine')))
  SELECT heading, split_part(lower(heading), ' ', 2) AS indicator_id FROM s""")
def sideways_tables(spark, sf_dir):
    """Headings over rows that are named for specimens, and the tests that they name."""
    sideways = inverted_tables(bound(spark, sf_dir, HEADED, "lineitem", "part"))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("indicator_id"))
    return sideways.join(heading_tests(sideways, names), "heading", "left")


@query(f"""WITH {TOKENS}, l AS (SELECT doc, sum(tf) AS len FROM p GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS m FROM l),
  f AS (SELECT doc, sum(tf) AS tf FROM p WHERE token LIKE 'heon%' GROUP BY 1), c AS (SELECT count(*) AS k FROM f),
  s AS (SELECT doc, -greatest(ln((g.n - k + 0.5) / (k + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / g.m)) AS score FROM f JOIN l USING (doc), g, c),
  r AS (SELECT *, row_number() OVER (ORDER BY score, doc) AS place, count(*) OVER () AS total FROM s)
  SELECT CAST(place AS INTEGER) AS place, doc AS doc_id, lang, round(score, 6) AS score, total FROM r JOIN documents ON doc_id = doc WHERE place > 5 AND place <= 25""")
def search_page(spark, sf_dir):
    """The second page of what a word finds, out of a kept index, of which only the word's partition is read."""
    rows, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    keep_index(row_postings(rows, "doc_id", ["text"]), path, lengths_of(rows, "doc_id", ["text"]))
    scored = kept_hits(spark, path, "heon")
    page = found(rows, None, "heon", "doc_id", "text", limit=20, offset=5, scored=scored)
    return page.select("place", "doc_id", "lang", F.round("score", 6).alias("score"), "total")


@query("SELECT split_part(p_name, ' ', 2) AS indicator_id, min(p_name) AS said FROM part WHERE p_name LIKE '% bo%' AND p_name LIKE 'co%' GROUP BY 1")
def tests_matching(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("indicator_id"), F.col("p_name").alias("name"))
    return indicators_matching(names, "Co bö")


# ---------------------------------------------------------------- what is left to do

FILED = "SELECT DISTINCT o_custkey AS file_id, l_linenumber AS page, l_linenumber % 2 = 0 AS tabular FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
SORTED = "SELECT o_custkey AS file_id, l_linenumber AS page FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 10"


@query(f"""WITH p AS ({FILED}), c AS (SELECT DISTINCT * FROM ({SORTED})), d AS ({DOCUMENTS}),
  ready AS (SELECT file_id FROM p LEFT JOIN c USING (file_id, page) GROUP BY 1 HAVING bool_and(c.page IS NOT NULL)),
  t AS (SELECT file_id, count(*) AS tables FROM p WHERE tabular AND page <= 3 GROUP BY 1)
  SELECT document_id, CAST(coalesce(tables, 0) AS INTEGER) AS tables FROM d JOIN ready USING (file_id) LEFT JOIN t USING (file_id)""")
def due_documents(spark, sf_dir):
    pages = bound(spark, sf_dir, FILED, "orders", "lineitem")
    classified = bound(spark, sf_dir, SORTED, "orders", "lineitem")
    documents = archive(spark, sf_dir).documents.select("document_id", "file_id", F.lit(1).alias("first"), F.lit(3).alias("last"))
    return work.due_documents(pages, classified, documents).select("document_id", F.size("tabular").alias("tables"))


@query(f"""WITH d AS ({DOCUMENTS}) SELECT document_id, date FROM d WHERE year(date) IN (1992, 1995, 1996, 1997)""")
def documents_of_years(spark, sf_dir):
    rows = archive(spark, sf_dir).documents.withColumn("year", F.year("date"))
    return work.of_years(rows, "year", "1995-1997, 1992").select("document_id", "date")


@query("""WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CASE WHEN len(pages) = 1 THEN 1 ELSE (len(pages) - 1 + 1) // 2 END::INTEGER AS calls, (len(pages) + greatest((len(pages) - 1 + 1) // 2 - 1, 0))::INTEGER AS sent FROM p""")
def calls_of_documents(spark, sf_dir):
    """A document's pages in calls of three, the first page in each."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("pages"))
    calls = pages.select("l_orderkey", work.call_chunks(F.col("pages"), 3).alias("calls"))
    return calls.select("l_orderkey", F.size("calls").alias("calls"), F.size(F.flatten("calls")).alias("sent"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey AS k, CAST(l_quantity AS INTEGER) * 20 AS spot FROM lineitem),
  r AS (SELECT k, min(spot) AS spot FROM p GROUP BY 1 UNION ALL SELECT r.k, (SELECT min(p.spot) FROM p WHERE p.k = r.k AND p.spot >= r.spot + 200) FROM r WHERE r.spot IS NOT NULL)
  SELECT k AS l_orderkey, CAST(count(spot) AS INTEGER) AS cuts, CAST(sum(spot) AS BIGINT) AS total FROM r GROUP BY 1""")
def text_cuts(spark, sf_dir):
    places = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int") * 20).alias("places"))
    cuts = places.select("l_orderkey", work.cuts_in(F.col("places")).alias("cuts"))
    return cuts.select("l_orderkey", F.size("cuts").alias("cuts"), F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH d AS ({DOCUMENTS}) SELECT copy_group, min(CASE WHEN primary_copy THEN document_id END) AS chosen, arg_min(date, document_id) FILTER (date IS NOT NULL) AS date,
  array_to_string(list_sort(list(document_id)), ',') AS members FROM d WHERE copy_group IS NOT NULL GROUP BY 1""")
def copy_group_members(spark, sf_dir):
    groups = work.copy_group_members(archive(spark, sf_dir).documents)
    return groups.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@query("SELECT user_id, event_id, event_type FROM events e WHERE event_id < (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)")
def earlier_readings(spark, sf_dir):
    return work.earlier_readings(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""WITH p AS (SELECT l_returnflag AS route FROM lineitem), c AS (SELECT l_returnflag AS route, max(l_quantity) AS seconds FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
  SELECT route, count(*) AS pages, round(count(*) * any_value(seconds) / 3600.0, 6) AS hours FROM p LEFT JOIN c USING (route) GROUP BY 1""")
def hours_by_route(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    prices = lines.where("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("route"), F.col("l_quantity").alias("seconds"))
    return work.hours_for(lines.select(F.col("l_returnflag").alias("route")), prices).withColumn("hours", F.round("hours", 6))


@query(f"""WITH d AS ({DOCUMENTS}), f AS (SELECT DISTINCT event_type AS rule, user_id AS document_id FROM events),
  v AS (SELECT event_type AS rule, user_id AS document_id, arg_max(event_id % 3, event_id) AS verdict FROM events WHERE value > 50 GROUP BY 1, 2)
  SELECT CASE rule WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS place, rule, document_id, date, verdict FROM f LEFT JOIN d USING (document_id) LEFT JOIN v USING (rule, document_id)""")
def review_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "rule", "user_id": "document_id"})
    verdicts = events.where("value > 50").select("rule", "document_id", F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("verdict"))
    out = work.review_rows(events, ["purchase", "view"], archive(spark, sf_dir).documents, verdicts)
    return out.withColumn("place", F.col("place").cast("int"))


@query("""WITH i AS (SELECT l_returnflag AS source, max(l_shipdate) AS newest FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS source, max(l_shipdate) AS built FROM lineitem WHERE l_returnflag <> 'R' AND l_tax > 0.03 GROUP BY 1)
  SELECT source, built IS NULL OR newest > built AS stale FROM i LEFT JOIN b USING (source)""")
def stale_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("at"), "l_tax")
    return work.stale(lines.where("source <> 'R' and l_tax > 0.03"), lines).select("source", "stale")


from . import printed_queries, view_queries  # noqa: E402, F401  register their own
