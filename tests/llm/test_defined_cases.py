"""Null ids, repeated rows, clashing columns and very long texts, for every operator."""

import random

import pytest
from llm_texts import ODD, documents, prose
from pyspark.sql import functions as F

from ledgerview.llm import decontaminate, line_dedup, lm_score, packing, pii, quality_knn, quality_rules, secret_scan, simhash_dedup, token_counts


@pytest.fixture(scope="module")
def strange(spark, odd):
    """Some ids null, every row twice."""
    some = odd.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    return some.unionByName(some)


def test_rows_stay_rows(spark, strange):
    n = 2 * len(ODD)
    assert token_counts.count_tokens(strange, "piece_bpe_32k.model").count() == n
    assert quality_rules.judge(strange).count() == n
    assert secret_scan.scan(strange).count() == n
    assert pii.pseudonymise(strange, "k").count() == n
    assert line_dedup.dedup_lines(strange).count() == n
    found = simhash_dedup.near_duplicates(strange)
    assert found.count() == n and found.filter("component_id is null and doc_id is not null").count() == 0
    words, weights = lm_score.train(strange)
    assert lm_score.score(strange, words, weights).count() == n
    labels = strange.select("doc_id", F.lit(1).alias("label"))
    assert quality_knn.score(strange, quality_knn.fit(strange, labels)).count() == n
    pieces = packing.pack(strange, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").toPandas()
    assert (pieces.start == 0).sum() == n and pieces.groupby("sequence_id").length.sum().max() <= 1024
    assert not pieces.duplicated(["sequence_id", "offset"]).any()


def test_stages_keep_clashing_columns(spark, odd):
    for stage in (quality_rules.stage, line_dedup.stage, simhash_dedup.stage):
        out = stage(spark, documents(spark, [prose(random.Random(1), 60), *ODD]), "")
        assert out.columns == odd.columns and {(r.n_words, r.h) for r in out.collect()} == {(1, "kept")}


def test_rows_without_an_id_stay_in_the_near_duplicate_stage(spark, strange):
    kept = simhash_dedup.stage(spark, strange, "")
    assert kept.filter("doc_id is null").count() == strange.filter("doc_id is null").count()


def test_very_long_text(spark):
    long_ = " ".join(f"w{random.Random(k).randrange(5000)}" for k in range(150_000))
    docs = documents(spark, [long_, "und.34@mail7.example.com " * 3000, "x@" + "a." * 20_000 + "b", "token=" + "k" * 100_000])
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs).collect()}[0] == 150_000
    assert token_counts.count_tokens(docs, "piece_bpe_32k.model").agg(F.min("n_tokens")).first()[0] > 0
    assert simhash_dedup.near_duplicates(docs).count() == 4 and line_dedup.dedup_lines(docs).count() == 4
    assert {r.doc_id: r.n_email for r in pii.pseudonymise(docs, "k").collect()}[1] == 3000
    assert {r.doc_id: r.n_assign for r in secret_scan.scan(docs).collect()}[3] == 1
    bench = spark.createDataFrame([(1, " ".join(long_.split()[70_000:70_060]))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()] == [(0, 1)]
