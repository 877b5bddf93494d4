"""Published key figures as a versioned state: what to show when a source is empty, or down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def published(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(scope, key, value) of rows that may be shown: published, with a key and a value that
    are not blank; of several rows for a key the first by `order`."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    shown = rows.where(F.coalesce("publish", F.lit(False))).select("scope", text("key").alias("key"), text("value").alias("value"), order)
    return shown.where("key <> '' AND value <> ''").groupBy("scope", "key").agg(F.min_by("value", order).alias("value"))


def from_snapshot(stats: Column) -> Column:
    """A snapshot's map of figures, from JSON: only text values that are not blank pass; no
    object at all is an empty map. Numbers and other kinds are dropped, not turned to text."""
    quoted = F.from_json(stats, "map<string, variant>")
    kinds = F.map_filter(quoted, lambda k, v: (k != "") & (F.schema_of_variant(v) == "STRING"))
    texts = F.transform_values(kinds, lambda k, v: F.variant_get(v, "$", "string"))
    return F.coalesce(F.map_filter(texts, lambda k, v: F.trim(v) != ""), F.create_map().cast("map<string, string>"))


def next_state(previous: DataFrame, read: DataFrame, reads: DataFrame) -> DataFrame:
    """The state after a round: (scope, key, value, version).

    previous: state of the round before; read: figures that were read now; reads: (scope,
    ok, version), one row for each scope of this round. A read that succeeded decides, also
    when it is empty: that is how a figure is withdrawn. A read that failed keeps what was
    there, and so does a scope without a read. Values that stay keep their version.
    """
    now = reads.select("scope", F.coalesce("ok", F.lit(False)).alias("ok"), "version")
    kept = previous.join(now.where("ok").select("scope"), "scope", "left_anti")
    fresh = read.join(now.where("ok").select("scope", "version"), "scope")
    before = previous.select("scope", "key", F.col("value").alias("_value"), F.col("version").alias("_version"))
    joined = fresh.join(before, ["scope", "key"], "left")
    same = F.col("_value").eqNullSafe(F.col("value"))
    return kept.select("scope", "key", "value", "version").unionByName(joined.select("scope", "key", "value", F.when(same, F.col("_version")).otherwise(F.col("version")).alias("version")))
