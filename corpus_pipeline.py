"""From raw documents to packed training sequences: quality, near duplicates, benchmark leaks, personal data, packing.

Every stage gets all documents that the one before kept, takes effect on them and, but for the last, returns the columns of
documents. Stages are written as Parquet and read again, so each starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontam, ngram_join, packing, pii, quality, queries, shared


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates: five words, a similarity of 0.8."""
    return ngram_join.keep_one_of_each(docs, k=5, percent=80).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return decontam.keep_clean(docs, queries.table(spark, sf_dir, "benchmark"), k=5, percent=80).select(docs.columns)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms of the same length."""
    return pii.pseudonyms(docs, queries.DEMO_KEY)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its packed sequence."""
    return packing.packed(docs, queries.BYTES, queries.END_ID)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("pii", pseudonymous), ("packing", sequences)]
#: No stage but the filters could be said in SQL, and those not on whole tables; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; an empty table gives an empty result.

    Null and empty texts go through all stages: scored like others, linked with nothing, and packed as their end id. Of
    equal rows with different ids the smallest id stays; rows that repeat an id, or have none, stay or go as each stage says.
    """
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, shared.stash(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.discard(before)  # only what an earlier stage wrote
    return STAGES[-1][1](spark, docs, sf_dir)
