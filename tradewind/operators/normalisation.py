"""Raw offer rows as offers: one select, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import brands, offers
from tradewind.functions.js import blank, half_up

#: The raw columns that may be read; others, such as costs, never reach an offer.
PUBLIC = (
    "id ord description variant brand category spec price_detail price_display price_type currency stock_display stock_cases terms tier "
    "origin featured volume_ml pcs_case pallet_cases pallet_pieces unit_type ean ean_case warehouse incoterm moq lead_time moq_type moq_qty "
    "moq_currency moq_source mixed_load lead_time_days bbd note offer_date expiry_date"
).split()
#: Text that passes unchanged, empty where null, and texts for which "Other" says nothing.
TEXTS = "spec terms tier origin unit_type ean ean_case moq lead_time moq_type moq_currency moq_source bbd note offer_date expiry_date".split()
CHOICES = "warehouse incoterm".split()
UNITS, PACKS = ["unit", "btl", "bottle", "can", "piece", "jar"], ["case", "pack"]


def normalised(raw: DataFrame) -> DataFrame:
    """Offers from raw rows, of which only the PUBLIC columns are read.

    The headline price, its currency and its basis come from the first priced part of one
    text; unit_amount is a price for one unit: the first part with a unit's basis, else the
    headline over the pack. Without a priced part, the displayed price stands alone. Null
    texts become empty, counts that are not positive null, flags that are not true false.
    """
    rows = raw.select(*PUBLIC).withColumn("price_detail", F.coalesce(blank(F.col("price_detail")), "price_display", F.lit("")))
    rows = rows.select("*", offers.price_parts(F.col("price_detail")).alias("_parts"), offers.amount(F.col("price_display")).alias("_shown"), offers.variants(F.col("description")).alias("_split"))
    head = F.get("_parts", F.lit(0))
    units = F.filter("_parts", lambda p: p["basis"].isin(UNITS))
    pack = F.coalesce(F.nullif(offers.pack_size(F.col("price_detail"), F.col("spec")), F.lit(0)), F.when(F.col("pcs_case") > 1, F.col("pcs_case")))
    shared = half_up(head["amount"] / pack * 10000) / 10000
    alone = F.lower(F.regexp_replace(F.coalesce("price_type", F.lit("")), "(?i)^per\\s+", ""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    variant = F.trim(text("variant"))
    return rows.select(
        "id",
        "ord",
        F.when(variant != "", offers.clean_name(F.col("description"))).otherwise(F.col("_split.name")).alias("name"),
        F.when(variant != "", variant).otherwise(F.col("_split.variants")).alias("variants"),
        brands.clean_brand(F.col("brand")).alias("brand"),
        F.coalesce(blank(F.col("category")), F.lit("Other")).alias("category"),
        F.coalesce(blank(F.col("currency")), blank(head["currency"]), offers.currency(F.col("price_display"))).alias("currency"),
        F.coalesce(head["amount"], "_shown").alias("amount"),
        F.when(F.size(units) > 0, F.get(units, F.lit(0))["amount"]).when(head["basis"].isin(PACKS), F.coalesce(shared, head["amount"])).otherwise(F.coalesce(head["amount"], "_shown")).alias("unit_amount"),
        "price_detail",
        F.when(F.size("_parts") > 0, head["basis"]).otherwise(alone).alias("price_basis"),
        offers.stock_code(F.col("stock_display")).alias("stock"),
        half_up(F.col("stock_cases")).cast("long").alias("qty"),
        *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("featured", "mixed_load")),
        "volume_ml",
        F.col("pcs_case").alias("pack"),
        *(offers.count_or_null(F.col(c)).alias(c) for c in ("pallet_cases", "pallet_pieces")),
        *(text(c).alias(c) for c in TEXTS),
        *(F.when(F.col(c) != "Other", F.col(c)).otherwise("").alias(c) for c in CHOICES),
        "moq_qty",
        "lead_time_days",
    )


def with_facets(offer: DataFrame) -> DataFrame:
    """Size, pack, kind of unit and place of each offer: own values first, else from its texts."""
    col = F.col
    split = offers.terms(col("terms"))
    return offer.withColumns(
        {
            "volume_ml": F.coalesce(half_up(F.when(col("volume_ml") > 0, col("volume_ml"))).cast("int"), offers.volume_ml(col("spec")), offers.volume_ml(col("name"))),
            "pack": F.coalesce(F.when(col("pack") > 0, col("pack")), offers.pack_size(col("price_detail"), col("spec"))),
            "unit_type": F.coalesce(blank(col("unit_type")), offers.unit_type(F.concat_ws(" ", "spec", "name"))),
            "incoterm": F.coalesce(blank(col("incoterm")), split["incoterm"]),
            "warehouse": F.coalesce(blank(col("warehouse")), split["warehouse"]),
        }
    )
