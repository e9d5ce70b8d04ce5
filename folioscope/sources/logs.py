"""Append-only JSON logs and tables: reading with torn lines counted, appending, replacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TORN = "_torn"


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines of a JSON log with `_torn`: the text of a line that does not parse, else null.

    Unknown keys are ignored and missing ones are null; blank lines are skipped by the reader.
    """
    whole = StructType([*schema.fields, StructField(TORN, StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", TORN).json(path)


def lines_and_torn(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col(TORN).isNull()).alias("lines"), F.count_if(F.col(TORN).isNotNull()).alias("torn"))


def sound(log: DataFrame) -> DataFrame:
    return log.where(F.col(TORN).isNull()).drop(TORN)


def append(rows: DataFrame, path: str) -> None:
    """Add lines; the committer makes them seen whole or not at all."""
    rows.write.mode("append").json(path)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object a file, over any number of lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def replace_table(rows: DataFrame, path: str, by: str = "source_id") -> None:
    """Write the tables of an archive; only the sources among the rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def one_source(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """The table of one source; there is no reader for several, so sources cannot meet.

    The partition filter prunes the other sources' files.
    """
    if not source_id:
        raise ValueError("a source is required")
    return spark.read.parquet(path).where(F.col("source_id") == source_id)
