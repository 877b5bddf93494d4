"""Row numbers within large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.js import numbered


def ranked(rows: DataFrame, key: str, order: str, name: str, bits: int = 16) -> DataFrame:
    """Rows with their number from 1 within `key`, by the whole-number column `order`.

    A group is numbered in cuts of 2**bits values of `order`, to which the counts of the cuts
    before are added, so no task sorts a whole group; only those counts are summed for each
    key. `order` must be unique within a key. Rows with a null key or order are left out.
    """
    cut = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("_cut", F.shiftright(F.col(order).cast("long"), bits))
    before = Window.partitionBy(key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(key, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(key, "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = cut.withColumn("_inside", numbered(Window.partitionBy(key, "_cut").orderBy(order)))
    return inside.join(sizes, [key, "_cut"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_cut", "_inside", "_before")
