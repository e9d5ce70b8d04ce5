"""Queries of the composed views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import dashboards
from .plans.archive import Filters
from .plans.bindings import DOCUMENTS, WITH, archive, bound
from .printed_queries import DOCTOR_LINES, PAPER, _SURNAME, _case, _concat
from .queries import PRIMARY, query

_MAKERS = """SELECT 'makers' AS part, concat(kind, ': ', name) AS key, count(*) AS n FROM (SELECT 'institution' AS kind, provider AS name FROM docs WHERE primary_copy UNION ALL SELECT 'doctor', doctor FROM docs WHERE primary_copy)
  WHERE trim(coalesce(name, '')) <> '' GROUP BY 1, 2"""


@query(f"""{WITH}, f AS (SELECT * FROM docs WHERE {PRIMARY} AND date >= DATE '1994-03-01')
  SELECT 'years' AS part, CAST(year(date) AS VARCHAR) AS key, count(*) AS n FROM f GROUP BY 2
  UNION ALL SELECT 'overview', 'documents', count(*) FROM docs WHERE primary_copy UNION ALL SELECT 'overview', 'transcribed', count(*) FROM docs WHERE primary_copy AND transcribed
  UNION ALL SELECT 'overview', 'without_date', count(*) FROM docs WHERE primary_copy AND date IS NULL UNION ALL SELECT 'overview', 'values_all', count(*) FROM obs JOIN docs USING (document_id)
  UNION ALL {_MAKERS} UNION ALL SELECT 'lanes', concat(coalesce(doc_type, '?'), ' ', CAST(year(date) AS VARCHAR)), count(*) FROM f GROUP BY 2""")
def timeline_view(spark, sf_dir):
    """Years, what the archive holds, who made it, and lanes of types."""
    return dashboards.timeline_view(archive(spark, sf_dir), Filters(since="1994-03-01"), feed="lanes")


GROUPED = "SELECT split_part(p_name, ' ', 2) AS label, CASE WHEN length(split_part(p_name, ' ', 2)) % 2 = 0 THEN 'approved' ELSE 'proposed' END AS status, p_name AS name FROM part WHERE p_partkey % 3 > 0"
USED = "SELECT upper(p_name) AS name, count(*) AS \"values\" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


@query(f"""WITH u AS (SELECT lower(name) AS f, min(name) AS name, sum("values") AS n FROM ({USED}) GROUP BY 1), g AS (SELECT DISTINCT label, status, lower(name) AS f FROM ({GROUPED})), x AS (SELECT * FROM u WHERE f NOT IN (SELECT f FROM g))
  SELECT 'group' AS part, label AS key, status, CAST(coalesce(sum(n), 0) AS BIGINT) AS "values", CAST(NULL AS BIGINT) AS total FROM g LEFT JOIN u USING (f) WHERE status = 'approved' GROUP BY label, status HAVING bool_or(contains(label, 'e') OR contains(f, 'e'))
  UNION ALL (SELECT 'name', name, NULL, CAST(n AS BIGINT), (SELECT count(*) FROM x) FROM x ORDER BY n DESC, name LIMIT 40)""")
def indicators_view(spark, sf_dir):
    """Approved groups that a search finds, how often their spellings are printed, and the most used names of none."""
    printed = bound(spark, sf_dir, USED.replace('"values"', "`values`"), "lineitem", "part")
    return dashboards.indicators_view(bound(spark, sf_dir, GROUPED, "part"), printed, find="E", status="approved", most=40)


DECIDED = "SELECT concat('Clinic ', CAST(s_suppkey % 40 AS STRING)) AS name, CASE WHEN s_suppkey % 40 < 10 THEN 'waiting' WHEN s_suppkey % 40 < 20 THEN 'refused' ELSE 'joined' END AS verdict FROM supplier"


@query(f"""{WITH}, o AS ({_SURNAME}), t AS (SELECT document_id, {_case('form', [_concat(f[1]) if f[1] else 'NULL' for f in DOCTOR_LINES])} AS name FROM o)
  {_MAKERS} UNION ALL SELECT 'decided', verdict, count(DISTINCT name) FROM ({DECIDED}) GROUP BY 2 UNION ALL SELECT 'doctors', name, count(DISTINCT document_id) FROM t WHERE name IS NOT NULL GROUP BY 2""")
def who_view(spark, sf_dir):
    """Who made the documents, what was decided of their names, and the doctors that pages name."""
    return dashboards.who_view(archive(spark, sf_dir), bound(spark, sf_dir, DECIDED, "supplier"), bound(spark, sf_dir, PAPER, "orders"))


TORN = "SELECT l_orderkey AS document_id, l_linenumber AS page, l_returnflag AS why FROM lineitem WHERE l_discount > 0.07"


@query(f"""WITH d AS ({DOCUMENTS}), t AS (SELECT document_id, min(page) AS first_page, array_to_string(list(concat(page, ':', why) ORDER BY page, why), ',') AS parts FROM ({TORN}) GROUP BY 1)
  SELECT file_id, document_id, first_page, parts FROM t JOIN d USING (document_id)""")
def unreadable_parts(spark, sf_dir):
    """Parts that nobody could read, by the file and page where a reader opens them."""
    out = dashboards.unreadable_parts(bound(spark, sf_dir, TORN, "lineitem"), archive(spark, sf_dir).documents)
    told = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["page"].cast("string"), p["why"])), ",")
    return out.select("file_id", "document_id", "first_page", told.alias("parts"))


READ = f"SELECT doc_type, date, CASE WHEN file_id % 3 = 0 THEN NULL ELSE concat('model ', CAST(file_id % 3 AS STRING)) END AS model FROM ({DOCUMENTS}) AS d"


@query(f"""WITH r AS ({READ}) SELECT 'type' AS "by", coalesce(doc_type, 'not said') AS key, count(*) AS documents FROM r GROUP BY 2 UNION ALL SELECT 'year', coalesce(CAST(year(date) AS VARCHAR), 'undated'), count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'model', coalesce(model, 'not said'), count(*) FROM r GROUP BY 2""")
def extract_summary(spark, sf_dir):
    """What was read, by type, by year and by model, in one pass."""
    return dashboards.extract_summary(bound(spark, sf_dir, READ, "orders"))
