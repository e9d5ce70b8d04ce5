"""The archive's roles played by the generated tables.  The SQL is read by Spark and by the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .archive import Archive

DOCUMENTS = """
SELECT o_orderkey AS document_id, o_custkey AS file_id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
       CASE WHEN o_orderstatus = 'F' THEN 'lab_panel' WHEN o_orderstatus = 'O' THEN 'report'
            WHEN o_orderkey % 5 = 0 THEN 'blank' WHEN o_orderkey % 5 = 1 THEN 'admin'
            WHEN o_orderkey % 5 = 2 THEN NULL ELSE 'imaging' END AS doc_type,
       CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE substring(o_orderpriority, 3, 20) END AS language,
       CASE WHEN o_custkey % 7 = 0 THEN '' ELSE concat('Clinic ', CAST(o_custkey % 40 AS STRING)) END AS provider,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('Dr ', CAST(o_custkey % 60 AS STRING)) END AS doctor,
       CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE concat('Form ', o_orderpriority) END AS title,
       o_orderkey % 10 <> 3 AS primary_copy, o_totalprice > 50000 AS transcribed,
       CASE WHEN o_orderkey % 10 IN (3, 4) THEN (o_orderkey - o_orderkey % 10) / 10 END AS copy_group
FROM orders
"""
OBSERVATIONS = """
SELECT l_orderkey * 10 + l_linenumber AS observation_id, l_orderkey AS document_id, l_linenumber AS page,
       p_name AS name, split_part(p_name, ' ', 2) AS indicator_id, l_quantity AS value_numeric,
       CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.05 THEN 'mg/l' WHEN l_tax < 0.075 THEN 'mmol/l' ELSE 'g/l' END AS unit,
       CASE WHEN l_returnflag = 'A' THEN 'blood' WHEN l_returnflag = 'N' THEN '' ELSE NULL END AS material,
       CASE WHEN l_linestatus = 'F' THEN 'no sample' END AS material_source,
       CASE WHEN l_discount > 0.08 THEN l_returnflag WHEN l_discount > 0.05 THEN ' ' END AS flag,
       CASE WHEN l_linestatus = 'O' AND l_discount < 0.02 THEN 'other' WHEN l_discount < 0.05 THEN 'result' END AS value_role,
       l_discount = 0.03 AS derived, l_extendedprice AS price
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
INDICATORS = "SELECT DISTINCT split_part(p_name, ' ', 2) AS indicator_id, split_part(p_name, ' ', 2) AS label FROM part UNION ALL SELECT 'nothing', 'Nothing'"

#: For oracle SQL: WITH documents, observations and indicators of these names.
WITH = f"WITH docs AS ({DOCUMENTS}), obs AS ({OBSERVATIONS}), inds AS ({INDICATORS})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """SQL over tables of a folder, by parameters, so that no view stays behind."""
    return spark.sql(sql_with_markers(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def sql_with_markers(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} {t}")
    return sql


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    return Archive(
        bound(spark, sf_dir, DOCUMENTS, "orders"),
        bound(spark, sf_dir, OBSERVATIONS, "lineitem", "part"),
        bound(spark, sf_dir, INDICATORS, "part"),
    )
