"""Pages of the catalogue: their slugs, site map, redirects, and lines that lead on from a page.

Every offer row has a page, live rows first; an old rule of slugs dropped accented letters.
Frames of pages hold ord, name, brand, category, delisted, slug, legacy_slug.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions import brands
from tradewind.functions.js import numbered
from tradewind.functions.offers import duty_class, price_unit, volume_text
from tradewind.operators.ranks import ranked
from tradewind.operators.slugs import deduped, legacy_brand_slugs

#: How many related lines a page shows.
RELATED = 4
#: For each list of a site map, how often its pages change, and their weight.
LISTS = {
    "home": ("daily", "1.0"),
    "category": ("daily", "0.9"),
    "brands": ("daily", "0.8"),
    "brand": ("daily", "0.7"),
    "offer": ("daily", "0.8"),
    "archive": ("monthly", "0.3"),
}


def pages(offers: DataFrame) -> DataFrame:
    """offers with slug and legacy_slug, suffixes in the order of pages: live rows, then the
    others, each by `ord` (a whole number below 2**62). Null names and specs are empty."""
    at = F.when(F.col("delisted"), F.col("ord") + F.lit(1 << 62)).otherwise(F.col("ord"))
    name, spec = F.coalesce("name", F.lit("")), F.coalesce("spec", F.lit(""))
    based = offers.withColumns({"_at": at, "slug": brands.slug(name, spec), "legacy_slug": brands.slug(name, spec, fold=False)})
    once = deduped(based, "_at", "slug").drop("slug").withColumnRenamed("unique_slug", "slug")
    return deduped(once, "_at", "legacy_slug").drop("legacy_slug", "_at").withColumnRenamed("unique_slug", "legacy_slug")


def xml_escape(text: Column) -> Column:
    for mark, stands in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(stands))
    return text


def sitemap(listed: DataFrame, brand_pages: DataFrame, others: list[tuple[str, str, str]]) -> DataFrame:
    """(list, path, changefreq, priority) of all pages worth a visit.

    listed: pages with canonical_slug. Live ones are listed once under the slug that stands
    for them; archived ones only where that is their own. brand_pages: slug. others: (path,
    changefreq, priority) of pages that are not made from rows; they come last. One scan of
    the pages for each list of them; only what has a page shuffles.
    """
    spark = listed.sparkSession
    path = lambda folder, slug: F.concat(F.lit(f"/{folder}/"), slug, F.lit("/"))
    canonical, live = F.coalesce("canonical_slug", "slug"), listed.where("NOT delisted")
    found = {
        "home": spark.range(1).select(F.lit("/").alias("path")),
        "category": live.where("category <> ''").select(path("category", brands.category_slug(F.col("category"))).alias("path")).distinct(),
        "brands": spark.range(1).select(F.lit("/brands/").alias("path")),
        "brand": brand_pages.select(path("brands", F.col("slug")).alias("path")),
        "offer": live.select(path("offers", canonical).alias("path")).distinct(),
        "archive": listed.where("delisted").where(canonical == F.col("slug")).select(path("offers", F.col("slug")).alias("path")),
    }
    parts = [rows.select(F.lit(k + 1).alias("list"), "path", *(F.lit(v).alias(c) for c, v in zip(("changefreq", "priority"), LISTS[name]))) for k, (name, rows) in enumerate(found.items())]
    if others:
        parts.append(spark.createDataFrame([(len(found) + 1 + k, *page) for k, page in enumerate(others)], "list int, path string, changefreq string, priority string"))
    return reduce(DataFrame.unionByName, parts)


def sitemap_entry(origin: str, built: str) -> Column:
    """The XML of one entry of `sitemap`."""
    tags = [("loc", xml_escape(F.concat(F.lit(origin), F.col("path")))), ("lastmod", F.lit(built)), ("changefreq", F.col("changefreq")), ("priority", F.col("priority"))]
    inner = [F.concat(F.lit(f"    <{tag}>"), value, F.lit(f"</{tag}>")) for tag, value in tags]
    return F.concat_ws("\n", F.lit("  <url>"), *inner, F.lit("  </url>"))


def moved(placed: DataFrame, brand_pages: DataFrame, retired: DataFrame) -> DataFrame:
    """(section, source, target, bare): redirects from paths that are no more.

    1: offers whose slug under the old rule is no page now. 2: old brand pages of a spelling
    whose brand has another page now; brand_pages: slug, variants (spellings). 3: retired
    (source, target) that no rule of 1 or 2 leads away; of those only the path with its
    slash was known, so `bare` is false.
    """
    path = lambda folder, slug: F.concat(F.lit(f"/{folder}/"), slug, F.lit("/"))
    changed = placed.where("legacy_slug <> slug").select("legacy_slug", "slug")
    offers = changed.join(placed.select(F.col("slug").alias("legacy_slug")), "legacy_slug", "left_anti")
    offers = offers.select(F.lit(1).alias("section"), path("offers", F.col("legacy_slug")).alias("source"), path("offers", F.col("slug")).alias("target"))
    old = legacy_brand_slugs(placed.where("NOT delisted")).withColumnRenamed("slug", "old")
    spelled = brand_pages.select("slug", F.explode("variants").alias("brand"))
    gone = old.join(spelled, "brand").where("old <> slug").join(brand_pages.select(F.col("slug").alias("old")), "old", "left_anti")
    both = offers.unionByName(gone.select(F.lit(2).alias("section"), path("brands", F.col("old")).alias("source"), path("brands", F.col("slug")).alias("target")))
    rest = retired.join(both, "source", "left_anti").select(F.lit(3).alias("section"), "source", "target")
    return both.withColumn("bare", F.lit(True)).unionByName(rest.withColumn("bare", F.lit(False)))


def redirect_lines(rules: DataFrame) -> DataFrame:
    """(section, line) of a redirect file: each rule, and where `bare`, its path without the
    slash at the end."""
    line = lambda source: F.concat_ws(" ", source, F.col("target"), F.lit("301"))
    twin = F.when(F.col("bare"), line(F.regexp_replace("source", "/\\z", "")))
    return rules.select("section", F.explode(F.array_compact(F.array(line(F.col("source")), twin))).alias("line"))


def ledger_lines(ledger: DataFrame) -> DataFrame:
    """(slug, line): an entry of the ledger as a JSON member, [brand, category, date]."""
    values = F.array(*(F.coalesce(c, F.lit("")) for c in ("brand", "category", "retired_on")))
    member = F.to_json(F.create_map("slug", values))
    return ledger.select("slug", F.substr(member, F.lit(2), F.length(member) - 2).alias("line"))


def related(placed: DataFrame, most: int = RELATED) -> DataFrame:
    """(ord, place, related): the live lines that each page leads on to, at most `most`.

    Lines of the same brand come first, in catalogue order; then a window of the category
    that begins at the row's own place in it, round the end, so that pages differ and stay
    the same from build to build. An archived row has no place and begins at the sum of its
    slug's character codes. No row leads to itself or twice to one line.

    A brand gives at most most + 1 rows, which partial limits cut before the shuffle. A
    window never needs more than `most` rows: as many of them as it repeats are filled by
    the brand already. Windows meet the category's rows on (category, place), not category.
    """
    live = placed.where("NOT delisted").select("ord", "brand", "category")
    key = F.lower(F.trim(F.coalesce("brand", F.lit(""))))
    first = live.select(key.alias("_brand"), "ord").where("_brand <> ''")
    first = first.withColumn("_n", numbered(Window.partitionBy("_brand").orderBy("ord"))).where(F.col("_n") <= most + 1)
    first = first.groupBy("_brand").agg(F.array_sort(F.collect_list("ord")).alias("_lines"))
    own = placed.select("ord", "category", "delisted", "slug", key.alias("_brand")).join(first, "_brand", "left")
    others = F.filter(F.coalesce("_lines", F.array().cast("array<bigint>")), lambda x: x != F.col("ord"))
    own = own.select("ord", "category", "delisted", "slug", F.slice(others, 1, most).alias("_same"))
    ranks = ranked(live.select("ord", "category"), "category", "ord", "_p").withColumn("_p", F.col("_p") - 1)
    sizes = live.groupBy("category").agg(F.count(F.lit(1)).alias("_size"))
    placed_live = own.where("NOT delisted").join(ranks.select("ord", "_p"), "ord", "left").join(sizes, "category", "left")
    codes = F.aggregate(F.transform(F.split("slug", ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, c: a + c)
    archived = own.where("delisted").join(sizes, "category", "left").withColumn("_p", codes)
    every = placed_live.unionByName(archived)
    n = F.coalesce("_size", F.lit(0)) - F.when(F.col("delisted"), 0).otherwise(1)  # lines to choose from
    wanted = F.least(n, F.lit(most)).cast("int")
    steps = F.when((F.size("_same") < most) & (wanted > 0), F.sequence(F.lit(0), wanted - 1))
    at = F.pmod(F.col("_p") + F.col("_k"), n)
    turn = every.select("ord", "category", "delisted", "_p", "_size", F.explode(steps).alias("_k"))
    turn = turn.select("ord", "category", "_k", F.when(~F.col("delisted") & (at >= F.col("_p")), at + 1).otherwise(at).alias("_p"))
    met = turn.join(ranks.select("category", "_p", F.col("ord").alias("_line")), ["category", "_p"])
    windows = met.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_line"))), lambda x: x["_line"]).alias("_window"))
    both = own.select("ord", "_same").join(windows, "ord", "left")
    fill = F.filter(F.coalesce("_window", F.array().cast("array<bigint>")), lambda x: ~F.array_contains("_same", x))
    return both.select("ord", F.posexplode(F.slice(F.concat("_same", fill), 1, most)).alias("place", "related"))


def brand_facts(offers: DataFrame, key: Column, minimum: Column, places: int = 3, sizes: int = 10) -> DataFrame:
    """What a brand's page can say that is true of all its lines: (key, offers, under_bond,
    duty_paid, floors, places, incoterm, sizes, more_sizes, minimum).

    floors: the lowest price of each currency, by case and by unit apart, since one is no
    bargain against the other; places: the most used warehouses; minimum: the house minimum
    if all lines fall under one. Each offer gives a few (kind, value) rows that are counted
    before they shuffle; what a window sorts are the distinct values of a brand and kind.
    """
    duty, unit, priced = duty_class(F.col("tier")), price_unit(F.col("price_basis")), F.col("amount").isNotNull() & (F.coalesce("currency", F.lit("")) != "")
    facts = {
        "all": F.lit(""),
        "under_bond": F.when(duty == "bond", ""),
        "duty_paid": F.when(duty == "paid", ""),
        "floor_case": F.when(priced & (unit == "case"), F.col("currency")),
        "floor_unit": F.when(priced & (unit == "unit"), F.col("currency")),
        "place": F.nullif(F.trim("warehouse"), F.lit("")),
        "incoterm": F.nullif(F.trim("incoterm"), F.lit("")),
        "size": F.when(F.col("volume_ml") > 0, F.format_string("%020d", F.col("volume_ml").cast("long"))),
        "minimum": F.when(F.coalesce("category", F.lit("")) != "", F.coalesce(minimum, F.lit(""))),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in facts.items()))
    said = offers.select(key.alias("key"), "ord", "amount", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("f")).where("key <> ''")
    counted = said.groupBy("key", "f.kind", "f.value").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.min("amount").alias("low"))
    common = F.when(F.col("kind").isin("place", "incoterm"), -F.col("n")).when(F.col("kind").startswith("floor"), F.col("first")).otherwise(0)
    kind = Window.partitionBy("key", "kind")
    most = F.when(F.col("kind") == "place", places).when(F.col("kind") == "size", sizes).when(F.col("kind") == "incoterm", 1).otherwise(1 << 30)
    spread = counted.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("values"))
    listed = counted.withColumn("r", numbered(kind.orderBy(common, "value"))).where(F.col("r") <= most).join(spread, ["key", "kind"])
    text = (
        F.when(F.col("kind").startswith("floor"), F.concat(F.col("value"), F.lit(" "), F.format_string("%.2f", "low"), F.when(F.col("kind") == "floor_case", " per case").otherwise(" per bottle or unit")))
        .when(F.col("kind") == "size", volume_text(F.col("value").cast("long")))
        .otherwise(F.col("value"))
    )
    of = lambda *kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("kind", "r", text.alias("text"))))), lambda x: x["text"])
    number = lambda name: F.coalesce(F.max(F.when(F.col("kind") == name, F.col("n"))), F.lit(0))
    width = lambda name: F.coalesce(F.max(F.when(F.col("kind") == name, F.col("values"))), F.lit(0))
    return listed.groupBy("key").agg(
        number("all").alias("offers"),
        number("under_bond").alias("under_bond"),
        number("duty_paid").alias("duty_paid"),
        of("floor_case", "floor_unit").alias("floors"),
        of("place").alias("places"),
        F.max(F.when(F.col("kind") == "incoterm", F.col("value"))).alias("incoterm"),
        of("size").alias("sizes"),
        F.greatest(width("size") - sizes, F.lit(0)).alias("more_sizes"),
        F.when(width("minimum") == 1, F.nullif(F.max(F.when(F.col("kind") == "minimum", F.col("value"))), F.lit(""))).alias("minimum"),
    )
