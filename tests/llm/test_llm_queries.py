"""Registered queries against their SQL, and the pipeline against plain Python."""

from collections import Counter

import compare
import edge
import pytest
from pyspark.sql import functions as F
from test_decontaminate import words
from test_minhash import plain

import corpus_pipeline
from guardframe.llm import queries
from guardframe.llm.common import fold
from guardframe.llm.langid import identify, train


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert compare.compare(spark, compare.duck(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


CONTRACT = {
    "op2_packing": "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    "op3_neighbours": "query_id long, rank int, vec_id long, score double",
    "op4_langid": "doc_id long, held_out boolean, lang_pred string, score double",
    "op5_extraction": "page_id long, url string, text string, n_chars long",
    "op6_lattice": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op8_minhash": "doc_id long, n_shingles long, component_id long, kept boolean",
    "op9_licenses": "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    "op10_warc": "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    "op11_phrases": "lang string, rank long, phrase string, a long, l long, r long, n long, score long",
    "op12_lines": "doc_id long, n_lines long, n_dropped long, kept_sha256 string",
    "op13_negatives": "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns(spark, sf_dir, name):
    kinds = dict(queries.QUERIES[name](spark, sf_dir).dtypes)
    assert list(kinds.items())[:8] == [
        (n, {"long": "bigint"}.get(k, k)) for n, k in (c.split(" ") for c in CONTRACT[name].split(", "))]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    field = train(docs.where(fold("doc_id", 5) > 0), noise=True)
    left = {r["id"] for r in identify(docs, field).where("lang_pred <> 'und'").collect()}
    classes = plain([(k, rows[k]) for k in left], 5, 80)
    left = {k for k in left if classes[k][1] == k}
    tests = [b" ".join(words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {k for k in left if not any(b" " + t + b" " in b" " + b" ".join(words(rows[k])) + b" " for t in tests)}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == left
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024


def test_language_stage_drops_noise(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # noise with a language's label would teach that it is that language
    scrambled = F.array_join(F.shuffle(F.split(F.substring("text", 1, 2000), ""), 5), "")
    noise = docs.where("doc_id % 3 = 0 and length(text) > 100").withColumn("text", scrambled).withColumn("doc_id", -F.col("doc_id") - 1) \
        .withColumn("lang", F.lit(None).cast("string"))
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(noise), sf_dir).collect()]
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert noise.count() > 40 and sum(k < 0 for k in kept) <= 1
    assert sum(k >= 0 for k in kept) >= 0.998 * lettered


def test_stages_take_awkward_rows(spark, sf_dir):
    docs = edge.documents(spark).withColumn("_nth", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if stage is not corpus_pipeline.packing:
            assert out.columns == docs.columns, name
            assert {r["_nth"] for r in out.collect()} == {"own"}
        assert stage(spark, edge.none(spark), sf_dir).collect() == []
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    kept = Counter(r["doc_id"] for r in out.collect())
    assert kept == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 10: 1, 11: 1, 12: 1, None: 2}
    assert corpus_pipeline.packing(spark, out, sf_dir).where(F.col("length") > 1024).isEmpty()
