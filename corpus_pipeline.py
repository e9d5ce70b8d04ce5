"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of
documents.  Part of the subpackage folioscope.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import discard, documents, staged
from folioscope.llm.decontaminate import decontaminated
from folioscope.llm.language import identify_languages
from folioscope.llm.mixing import mixed_documents
from folioscope.llm.sharding import shard_documents
from folioscope.llm.simhash import near_unique

#: Texts with less than this share of their letters in scripts of learned languages are rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts that no learned language explains,
    however many languages a text mixes; `lang` becomes the one with most letters.

    Learns from rows of docs with text and language; where there are none, all rows go.  Rows that
    repeat are judged alike, and null ids, sources and lengths stay as they are.
    """
    carry = {name: f"_{k}" for k, name in enumerate(docs.columns)}
    found = identify_languages(docs, carry=carry, known="_known").where((F.col("lang_pred") != "und") & (F.col("_known") >= LEAST_SHARE))
    return found.select(*[F.col("lang_pred" if old == "lang" else new).alias(old) for old, new in carry.items()])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles >= 0.8) stays: the
    one with the smallest id, a null id being larger than any, and of rows that repeat it one.

    Texts without a word, null ones too, are copies of each other.
    """
    return near_unique(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go; null and empty texts hold none, and stay."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, one row for each time over; doc_id stays.

    A null source is a source of its own; texts without a word have nothing to take, and go.  Of
    rows that repeat source, id and text the first one's words count for each.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix is stored: shard and slot.  Null ids share a shard, null texts are empty."""
    return shard_documents(docs, 24)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written before the next; what it was made of is removed then."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models, fingerprints and permutations are not for SQL; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None
