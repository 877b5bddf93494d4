"""Quality by importance resampling: hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models over hashed words and word pairs are fitted: one to documents
labelled good, one to all documents. The mean log ratio of the two is a document's
importance. Adding Gumbel noise and keeping the k greatest draws k documents without
replacement in proportion to their importance weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import passes, runs, staged, text_bytes, words

#: Buckets of the hashed n-grams.
BITS = 14
#: At most so many labelled rows of either label are read, those with least hash.
LABELLED = 4000
#: Importance (mean log ratio) that one unit of Gumbel noise is worth: small against the
#: distance between good and bad documents, so that noise decides only between near ones.
TEMPERATURE = 0.002


@dataclass
class Model:
    """log(target / raw) for each bucket, and the importance that parts the labels."""

    ratio: np.ndarray
    cut: float


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each word and of each pair of words."""
    _, _, docs, hashes = words(*text_bytes(column))
    two = runs(hashes, 2)
    same = docs[1:] == docs[:-1]
    every = np.concatenate([hashes, two[same]])
    return np.concatenate([docs, docs[:-1][same]]), (every >> np.uint64(64 - BITS)).astype(np.int64)


def importance(ratio: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean log ratio of each text; not a number for a text without words."""
    docs, buckets = _features(column)
    n = np.bincount(docs, minlength=len(column))
    total = np.bincount(docs, ratio[buckets], len(column))
    return np.divide(total, n, out=np.full(len(column), np.nan), where=n > 0)


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """The raw model counts every n-gram of all documents; the target model those of the
    sampled good rows. None without rows of both labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id")).limit(labelled) for k in (0, 1)]
    chosen = chosen[0].union(chosen[1]).hint("broadcast")  # at most 2 * labelled rows of 12 bytes
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in passes(batches):
            docs, buckets = _features(batch.column("text"))
            sums[0] += np.bincount(buckets, minlength=1 << BITS)
            good = np.flatnonzero(batch.column("quality").fill_null(0).to_numpy(zero_copy_only=False) == 1)
            if len(good):
                sums[1] += np.bincount(buckets[np.isin(docs, good)], minlength=1 << BITS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "good"])

    marked = plain.join(chosen, "doc_id", "left").select("text", "quality")
    counted = marked.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good"))
    sums = np.zeros((2, 1 << BITS))
    for bucket, raw, good in counted.collect():  # at most 2 ** BITS rows
        sums[:, bucket] = raw, good
    if not sums[1].any():
        return None
    share = np.log((sums + 1) / (sums.sum(1, keepdims=True) + (1 << BITS)))
    ratio = share[1] - share[0]
    # The cut that parts the sampled labels best, each label weighing the same.
    known = _scored(plain.join(chosen, "doc_id"), ratio, ["quality"]).where("NOT isnan(importance)").select("importance", "quality").orderBy("importance").collect()
    values, good = np.array([r[0] for r in known]), np.array([r[1] for r in known])
    if not len(good) or good.min() == good.max():
        return None
    below_bad = np.append(0, np.cumsum(good == 0)) / (good == 0).sum()
    below_good = np.append(0, np.cumsum(good == 1)) / (good == 1).sum()
    at = int(np.argmax(below_bad - below_good))
    return Model(ratio, float(np.append(values, np.inf)[at] if at == 0 else (values[at - 1] + values[min(at, len(values) - 1)]) / 2))


def _scored(docs: DataFrame, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """importance beside the kept columns; docs has text."""
    broadcast = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(importance(broadcast.value, batch.column("text")))], [*keep, "importance"])

    picked = docs.select(*keep, "text")
    schema = picked.select(*keep).schema.add("importance", "double")
    return picked.mapInArrow(run, schema)


def _drawn(importance, doc_id):
    """Importance in units of noise, plus the row's own Gumbel noise."""
    uniform = (F.pmod(F.xxhash64(doc_id, F.lit("gumbel")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return importance / TEMPERATURE - F.log(-F.log(uniform))


def kth_greatest(values: DataFrame, column: str, k: int) -> float:
    """The k-th greatest of a double column without sorting it: the range that holds it is
    cut into 4,096 slots until only equal values are left; a round brings the slots' counts
    to the driver."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = max((hi - lo) / 4096, 1e-300)
        slot = F.least(F.floor((F.col(column) - lo) / width), F.lit(4095).cast("long"))
        inside = values.where(F.col(column).between(lo, hi))
        above = values.where(F.col(column) > hi).count()
        slots = inside.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("s")).collect()
        for row in slots:
            above += row["n"]
            if above >= k:
                lo, hi = row["lo"], row["hi"]
                break
    return float(lo)


def quality(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, importance, drawn and kept for each row of documents.

    As many documents are kept as have an importance of at least the model's cut. Null and
    empty texts and those without words have no importance and go. Without labels of both
    kinds, all rows with words stay. Rows with equal drawn values stay or go together.
    """
    model = model or fit(documents, labels)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = _scored(plain, model.ratio if model else np.zeros(1 << BITS), ["doc_id"])
    scored = scored.withColumn("drawn", _drawn(F.col("importance"), F.col("doc_id")))
    scored = staged(scored, "scored")
    least = _least(scored, model)
    return scored.withColumn("kept", ~F.isnan("importance") & (F.col("drawn") >= least))


def _least(scored: DataFrame, model: Model | None) -> float:
    real = scored.where("NOT isnan(importance)")
    k = real.where(F.col("importance") >= model.cut).count() if model else 0
    return kth_greatest(real, "drawn", k) if k else (float("-inf") if model is None else float("inf"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that quality() keeps, with all their columns."""
    model = fit(documents, labels)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = model.ratio if model else np.zeros(1 << BITS)
    drawn = staged(_scored(plain, ratio, ["doc_id"]).withColumn("drawn", _drawn(F.col("importance"), F.col("doc_id"))), "drawn")
    least = _least(drawn, model)
    # Scored again rather than joined: the text is read twice and shuffled never.
    whole = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = _scored(whole, ratio, ["row", "doc_id"])
    kept = again.where(~F.isnan("importance") & (_drawn(F.col("importance"), F.col("doc_id")) >= least))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
