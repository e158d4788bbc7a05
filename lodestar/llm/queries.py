"""The queries of this subpackage: each applies an operator to its whole table; and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_join, ngram_join, packing, pii, quality, shards, shared, substrings, tokenfiles, warc_audit

#: Public vocabularies by name; a worker looks up where it has them.
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 1
#: A key for tests and checks; a real run passes its own.
DEMO_KEY = b"not a secret: pass your own key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, percent=80)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonyms(docs, DEMO_KEY, count_col="n_replaced")


def op5_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.uniform_shards(table(spark, sf_dir, "documents"), shards=16)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf_dir, "documents"), window=50)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.fresh_path(spark, "token-files")
    manifest = tokenfiles.write_ids(table(spark, sf_dir, "documents"), folder, WORDS, END_ID, spaces=False)
    return tokenfiles.read_digests(manifest, folder)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTES, END_ID)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica in which some records have a byte changed, and some files end early."""
    folder, replica = (shared.fresh_path(spark, "warc") for _ in range(2))
    page = F.col("page_id")
    damage = F.when((page % 1000 >= 900) & (F.floor(page / 1000) % 7 == 3), "missing").when(page % 97 == 5, "altered")
    index = warc_audit.write_warc(warc_audit.records(table(spark, sf_dir, "pages")), folder, replica, damage=damage)
    return warc_audit.audit(index, folder, replica)


OP10_SQL = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
      || html || chr(13) || chr(10) || chr(13) || chr(10) AS bytes
  FROM pages
)
SELECT page_id, 'warc-' || (page_id // 1000) || '-0' AS file, CAST(row_number() OVER w - 1 AS INTEGER) AS record,
  CAST(sum(strlen(bytes)) OVER w - strlen(bytes) AS BIGINT) AS "offset", CAST(strlen(bytes) AS BIGINT) AS length, sha256(bytes) AS sha256,
  CASE WHEN page_id // 1000 % 7 = 3 AND page_id % 1000 >= 900 THEN 'missing' WHEN page_id % 97 = 5 THEN 'altered' ELSE 'intact' END AS state
FROM r WINDOW w AS (PARTITION BY page_id // 1000 ORDER BY page_id ROWS UNBOUNDED PRECEDING)
"""


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_benchmark_decontamination, op3_quality_classifier, op4_pii_pseudonyms, op5_uniform_shards, op6_substring_dedup, op7_ngram_jaccard_join, op8_token_files, op9_packing, op10_warc_fixity)}
ORACLE_SQL = {"op10_warc_fixity": OP10_SQL}
