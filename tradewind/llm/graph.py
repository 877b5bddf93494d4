"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each linked id can reach.

    Each round points every id's greater neighbours at its smallest one (large star), then
    its smaller neighbours at the smallest of them (small star); the rounds needed grow with
    the logarithm of the longest chain. Ids without links, null ids and loops give no
    rows. Each round is staged, so nothing depends on one executor, and a hub's links can be
    split: both sides of each join are written tables.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = staged(edges, "edges")
    before = None
    while True:
        least = staged(edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "least")
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = staged(large, "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        edges = staged(small, "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        if now == before or now[0] == 0:
            break
        before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(edges.select("v", "v").distinct())
