"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .conversations import grafted, numbered_turns, prefix_trie
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup, sha256_hex
from .html_text import extract_text
from .language import identify_languages
from .mixing import mix_sources
from .negatives import hard_negatives
from .packing import pack_documents
from .secrets import scan_secrets
from .sharding import shard_documents
from .simhash import near_dedup
from .substrings import remove_repeated
from .toxicity import grades_of_labels, score_toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of documents, and which row of each stays."""
    return exact_dedup(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 24 shards by their ids, with slots."""
    return shard_documents(documents(spark, sf_dir), 24)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and the components that near ones make."""
    return near_dedup(documents(spark, sf_dir)).drop("kept")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, or nearly."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents, and how widely each is held."""
    return scan_secrets(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three quarters of them."""
    return identify_languages(documents(spark, sf_dir)).drop("spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that occur elsewhere too, as digests."""
    rows = remove_repeated(documents(spark, sf_dir), window=35)
    return rows.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of each document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(documents(spark, sf_dir), grades_of_labels(labels))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids, with a digest of each piece's ids."""
    import public_tokenizers

    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the label of every seventh is moved on by one."""
    vectors, ident, label = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(ident % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors.withColumn("label", moved), ident % 100 == 0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of conversations that take their first turns from that of their hundred."""
    turns = numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_trie(*grafted(turns, F.col("conv_id") - F.col("conv_id") % 100, heads, most=5))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3_secret_scan SQL can say: how many spans of each base kind a document has."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6_mix_sources SQL can say: sources, their sizes and targets."""
    rows = op6_mix_sources(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(
        F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), (F.abs(F.sum("taken") - F.max("target")) <= 0.5).alias("met")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_decontaminate, op3_secret_scan, op4_substring_dedup, op5_html_extract, op6_mix_sources, op7_toxicity, op8_language_id, op9_sharding, op10_simhash, op11_packing, op12_hard_negatives, op13_conversation_trie, secret_counts, mix_targets, pipeline)}

SQL = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM w),
        v AS (SELECT doc_id, j, words[j] AS word, CASE WHEN j + 34 <= len(words) THEN words[j : j + 34] END AS win FROM p),
        c AS (SELECT doc_id, j, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM v),
        d AS (SELECT doc_id, j, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM c),
        k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM d GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN k USING (doc_id)
    """,
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
              FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
    """,
    "op13_conversation_trie": """
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                          coalesce(role, '') AS who, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
        l AS (SELECT c, list({'who': who, 'said': said} ORDER BY pos) AS turns FROM t GROUP BY c),
        h AS (SELECT c, turns, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
                 lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 6)::INT AS heads FROM l),
        r AS (SELECT h.c, list_concat(coalesce(b.turns[1 : h.heads], []), h.turns[h.heads + 1 :]) AS path FROM h LEFT JOIN l b ON b.c = h.c - h.c % 100),
        p AS (SELECT c, len(path) AS n, d, path[1 : d] AS path FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM r)),
        nodes AS (SELECT d AS depth, path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, path),
        kids AS (SELECT depth - 1 AS depth, path[1 : depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        own AS (SELECT o.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * coalesce(length(o.path[o.depth].said), 0) AS saved FROM nodes o LEFT JOIN kids k ON k.depth = o.depth AND k.path = o.path),
        up AS (SELECT n_children, saved, a AS depth, path[1 : a] AS path FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM own)),
        sums AS (SELECT depth, path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY depth, path)
        SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
        FROM own o JOIN sums s ON s.depth = o.depth AND s.path = o.path LEFT JOIN nodes u ON u.depth = o.depth - 1 AND u.path = o.path[1 : o.depth - 1]
    """,
    "secret_counts": r"""
        SELECT doc_id,
               len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
               len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
               len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
        FROM documents
    """,
    "mix_targets": r"""
        WITH z AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
        s AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
                     (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM z),
        -- A level for each set of sources that it cuts off; the right one shares everything.
        b AS (SELECT 0.0::DOUBLE AS edge UNION SELECT cap / weight FROM s),
        l AS (SELECT (SELECT sum(source_size) FROM s) AS whole, edge,
                     ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(cap) FROM s WHERE cap / weight <= edge), 0)) / (SELECT sum(weight) FROM s WHERE cap / weight > edge) AS level FROM b),
        f AS (SELECT level FROM l WHERE abs((SELECT sum(least(cap, level * weight)) FROM s) - whole) <= 1e-6 * whole ORDER BY edge LIMIT 1)
        SELECT source, source_size, round(least(cap, level * weight), 3) AS target, TRUE AS met FROM s, f
    """,
}
