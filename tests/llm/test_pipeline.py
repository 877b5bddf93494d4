import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, docs, DATA), name)
        assert out.columns == columns, name
        ids = [r[0] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        if name == "exact_dedup":
            assert out.select("text").distinct().count() == len(ids)
        if name == "pii":
            assert len(ids) == len(seen)
        seen, docs = set(ids), out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == seen


def test_exact_stage_keeps_one_row_of_each_text(spark):
    rows = [(1, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "c"), (5, "d"), (6, None), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _id string, _kept int")
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(3, "a"), (None, "b"), (5, "c"), (5, "d"), (7, "")], key=str)
    assert corpus_pipeline.drop_copies(spark, docs.where("false"), "").count() == 0


def test_stages_of_nothing_and_of_rows_without_ids(spark):
    labels = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{labels}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), labels).count() == 0, name
        out = stage(spark, docs, labels)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
