"""Streaming forms of the demand digest and of the ledger. These extend the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_demand(events: DataFrame, late: str = "1 day", width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Asks and buyers by product in sliding windows. Events later than `late` are dropped
    by the watermark, which also bounds the state; buyers are counted approximately."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width, slide).alias("w"), F.lower("event_type").alias("k"))
        .agg(F.count(F.lit(1)).alias("asks"), F.approx_count_distinct("user_id").alias("buyers"))
        .select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "k", "asks", "buyers")
    )


def once_each(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "slug", version: str = "ts") -> StreamingQuery:
    """Upsert a stream into versioned Parquet state: each batch writes version n + 1 from
    version n, and a version marker last, so that a repeated batch gives the same state."""

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = batch
        if n:
            state = spark.read.parquet(f"{path}/version={n - 1}").drop("version").unionByName(batch)
        rest = [c for c in batch.columns if c != key]
        latest = state.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/version={n}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
