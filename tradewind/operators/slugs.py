"""Slug suffixes when natural slugs may look like generated ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import brands as brand_functions


def deduped(slugs: DataFrame, order: str = "ord", slug: str = "slug") -> DataFrame:
    """slugs with `unique_slug`: the first free of slug, slug-2, slug-3 ... in order.

    Only slugs that are equal without trailing numbers can meet, so each such root is
    folded on its own. The fold of a root needs its rows in order; rows stream through it
    and only the slugs taken so far and a counter for each are kept.
    """
    rooted = slugs.withColumn("_root", F.regexp_replace(slug, "(-[0-9]+)+\\z", ""))
    parted = rooted.repartition("_root").sortWithinPartitions("_root", order).drop("_root")
    schema = slugs.schema.add("unique_slug", "string")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, taken, after = None, set(), {}
        for batch in batches:
            out = []
            for name in batch[slug]:
                own = re.sub(r"(-[0-9]+)+\Z", "", name)
                if own != root:
                    root, taken, after = own, set(), {}
                free, k = name, after.get(name, 2)
                while free in taken:
                    free, k = f"{name}-{k}", k + 1
                    after[name] = k
                taken.add(free)
                out.append(free)
            yield batch.assign(unique_slug=out)

    return parted.mapInPandas(fold, schema)


def legacy_brand_slugs(offers: DataFrame, least: int = 2, locale: str = "UNICODE") -> DataFrame:
    """(brand, slug) of the pages that each spelling of a brand used to have: those with
    `least` offers or more, suffixes in the locale's order of the spellings. Accented letters
    were dropped. Spellings without a letter or digit had none.

    Spellings are as many as they are, so their order is by ranges: a place is a number of
    the partition and of the row in it, and only spellings of one root meet in the fold.
    """
    spelled = offers.select(F.trim(F.coalesce("brand", F.lit(""))).alias("brand")).where("brand <> ''").groupBy("brand").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    base = brand_functions.slug(F.col("brand"), fold=False)
    named = spelled.withColumn("_base", base).where("_base <> ''").select("brand", F.concat("_base", F.lit("-wholesale")).alias("slug"), F.collate("brand", locale).alias("_sorted"))
    placed = named.repartitionByRange("_sorted", "brand").sortWithinPartitions("_sorted", "brand").withColumn("ord", F.monotonically_increasing_id())
    return deduped(placed.select("brand", "slug", "ord")).select("brand", F.col("unique_slug").alias("slug"))
