"""A training corpus from raw documents, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import staged
from tradewind.llm.exact_dedup import exact_dedup, text_digest
from tradewind.llm.near_dedup import near_dedup
from tradewind.llm.packing import pack_documents
from tradewind.llm.pii import redact
from tradewind.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a document without id only where
    no equal one has an id. Of rows that repeat both id and text, one."""
    decided = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    marks = staged(decided.where("NOT _kept OR _n > 1"), "marks").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"), "_kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("id"), text_digest().alias("digest"))
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    stay = rows.join(marks, match, "left_anti").select("row.*")
    again = marks.where("_kept")
    if again.isEmpty():  # no id and text stand twice: no second pass over the documents
        return stay
    return stay.unionByName(rows.join(again, match).dropDuplicates(["id", "digest"]).select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the document with the smallest id."""
    gone = near_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).dropDuplicates()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their place in sequences."""
    return pack_documents(docs, keep_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot tokenise, pack or draw; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
