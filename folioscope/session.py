"""A session with the settings that the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything else as the cluster has it."""
    builder = SparkSession.builder.appName("folioscope")
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names as spark.checkpoint.dir.  In
    local mode, where one machine is all there is, a temporary one if none is named; on a cluster
    that is an error, for executors would not see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet into the folder that driver and executors share, and read again.

    A reader takes the columns that it needs, and Spark knows the size before it plans: a small table
    is broadcast and what it meets is not shuffled, a large one is shuffled.
    """
    untyped = {c for c, t in df.dtypes if t == "void"}  # Parquet has no such type
    kept = df.drop(*untyped)
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    kept.write.parquet(path)
    out = df.sparkSession.read.schema(kept.schema).parquet(path)
    return out.select(*[F.lit(None).alias(c) if c in untyped else out[c] for c in df.columns])
