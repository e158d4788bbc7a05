"""The registered queries as they are: their columns, types and laws over the small tables, and the pipeline on odd rows."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodestar.llm import queries

from . import brute

CONTRACT = {
    "op1_embedding_near_dedup": ("embeddings", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}),
    "op3_quality_classifier": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op4_pii_pseudonyms": ("documents", {"doc_id": "bigint", "text": "string", "n_replaced": "bigint"}),
    "op5_uniform_shards": ("documents", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}),
    "op6_substring_dedup": ("documents", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}),
    "op7_ngram_jaccard_join": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}),
    "op8_token_files": ("documents", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}),
    "op10_warc_fixity": ("pages", {"page_id": "bigint", "file": "string", "record": "int", "offset": "bigint", "length": "bigint", "sha256": "string", "state": "string"}),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_a_row_for_each_of_the_table(spark, sf_dir, name):
    table, types = CONTRACT[name]
    found = entry.queries()[name](spark, sf_dir)
    assert dict(found.dtypes) == types
    given = queries.table(spark, sf_dir, table)
    assert sorted(r[0] for r in found.select(found.columns[0]).collect()) == sorted(r[0] for r in given.select(given.columns[0]).collect())


def test_jaccard_query_is_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    wanted = brute.components(list(docs), brute.jaccard_links(docs, 3, 90))
    found = entry.queries()["op7_ngram_jaccard_join"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {d: (len(brute.shingle_set(t, 3)), wanted[d]) for d, t in docs.items()}


def test_substring_query_is_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    wanted = brute.kept_words(docs, 50)
    for r in entry.queries()["op6_substring_dedup"](spark, sf_dir).collect():
        assert r["n_words"] - r["n_removed"] == len(wanted[r["doc_id"]])


def test_packing_query_covers_each_document_once(spark, sf_dir):
    found = entry.queries()["op9_packing"](spark, sf_dir)
    sums = {r["doc_id"]: (r["n"], r["most"]) for r in found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most")).collect()}
    assert all(n == most for n, most in sums.values()) and len(sums) == queries.table(spark, sf_dir, "documents").count()


def test_leaks_query(spark, sf_dir):
    found = entry.queries()["op2_benchmark_decontamination"](spark, sf_dir)
    assert found.columns == ["doc_id", "item_id", "similarity", "start_word", "windows"] and found.where("similarity < 0.8").isEmpty()


def test_odd_rows_in_the_stages(spark, sf_dir):
    """Rows without an id or text, long texts, ties and clashing columns go through all stages."""
    long = " ".join(f"word{i}" for i in range(30_000))
    given = [(1, None), (2, ""), (3, long), (4, long), (5, "A tie of two rows that are one document each time."), (5, "A tie of two rows that are one document each time."), (None, "no id here"), (None, None)]
    docs = spark.createDataFrame([(*g, "en", "s", 1, 2, "t") for g in given], "doc_id long, text string, lang string, source string, n_chars long, leader int, tokens string")
    for name, stage in corpus_pipeline.STAGES[1:]:  # what the classifier keeps of such texts is its own affair
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {d for d, _ in before}
            break
        assert out.columns == docs.columns
        after = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        gone = [(4, long)] if name == "near_duplicates" else []
        assert after == sorted((r for r in before if r not in gone), key=str)
        docs = out
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf_dir).isEmpty() for _, stage in corpus_pipeline.STAGES)


def test_shard_digests(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in entry.queries()["op5_uniform_shards"](spark, sf_dir).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
