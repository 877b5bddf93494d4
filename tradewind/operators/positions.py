"""Rows by their place in an order, and lists joined place by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranks import ranked


def positioned(rows: DataFrame, order: str, name: str = "position", bits: int = 16) -> DataFrame:
    """rows with their place from 1 in the whole list, by the unique whole-number column
    `order`; rows without one are left out.

    Cuts of 2**bits values are numbered apart and shifted by the counts of the cuts before:
    no task sorts the list, and only the counts, one for each cut, come together.
    """
    return ranked(rows.withColumn("_all", F.lit(0)), "_all", order, name, bits).drop("_all")


def zipped(left: DataFrame, right: DataFrame, order: str, name: str = "position", bits: int = 16) -> DataFrame:
    """Row i of left beside row i of right, as structs `left` and `right`; the longer list's
    last rows stand alone. An equi-join of places, spread like any other."""
    sides = [positioned(side, order, "_at", bits).select(F.col("_at").alias(name), F.struct(*side.columns).alias(label)) for side, label in ((left, "left"), (right, "right"))]
    return sides[0].join(sides[1], name, "full")
