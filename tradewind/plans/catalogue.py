"""Roll-ups, rankings and set operations over the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.functions import brands
from tradewind.functions.js import numbered
from tradewind.operators.ranks import ranked
from tradewind.plans.registry import query

_SHOUT = "(length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) > 1 AND regexp_replace({0}, '[^A-Za-z]', '', 'g') = upper(regexp_replace({0}, '[^A-Za-z]', '', 'g')))"
_ELECT = f"SELECT k, brand AS canonical FROM (SELECT lower(brand) AS k, brand, row_number() OVER (PARTITION BY lower(brand) ORDER BY count(*) DESC, {_SHOUT.format('brand')}, brand) AS r FROM offers WHERE brand <> '' GROUP BY brand) WHERE r = 1"


def elected(offers):
    """(k, canonical): for each case-folded brand its most used, then least shouting, then
    first spelling. Spellings are counted before they meet, so no window holds offers."""
    counts = offers.where("brand <> ''").groupBy("brand").count()
    best = F.min_by("brand", F.struct(-F.col("count"), brands.is_shouting(F.col("brand")), F.col("brand")))
    return counts.groupBy(F.lower("brand").alias("k")).agg(best.alias("canonical"))


@query("a1_brand_election", _ELECT, "offers")
def brand_election(o):
    return elected(o)


@query("j16_canonical_brands", f"SELECT o.ord, coalesce(c.canonical, o.brand) AS brand FROM offers o LEFT JOIN ({_ELECT}) c ON lower(o.brand) = c.k", "offers")
def canonical_brands(o):
    return o.join(elected(o), F.lower("brand") == F.col("k"), "left").select("ord", F.coalesce("canonical", "brand").alias("brand"))


@query("a2_distinct_brands", "SELECT count(DISTINCT lower(brand)) AS n FROM offers WHERE brand <> ''", "offers")
def distinct_brands(o):
    return o.agg(F.countDistinct(F.nullif(F.lower("brand"), F.lit(""))).alias("n"))


@query(
    "a3_a4_brand_pages",
    """SELECT max(display) AS brand, key || '-wholesale' AS slug, CAST(sum(n) AS BIGINT) AS offers, string_agg(brand, '|' ORDER BY brand) AS variants FROM (
         SELECT *, first_value(brand) OVER (PARTITION BY key ORDER BY regexp_matches(brand, '[A-Z]{2}') AND brand = upper(brand) AND length(brand) > 3, n DESC, brand) AS display
         FROM (SELECT brand, replace(lower(brand), '#', '') AS key, count(*) AS n FROM offers WHERE brand <> '' AND NOT delisted GROUP BY brand))
       GROUP BY key HAVING sum(n) >= 2""",
    "offers",
)
def brand_pages(o):
    counts = o.where("brand <> '' AND NOT delisted").groupBy("brand").agg(F.count(F.lit(1)).alias("n")).withColumn("key", brands.slug(F.col("brand")))
    shouting = F.col("brand").rlike("[A-Z]{2}") & (F.col("brand") == F.upper("brand")) & (F.length("brand") > 3)
    plain = ~F.col("brand").rlike("[^\\x00-\\x7F]")
    order = F.struct(shouting, -F.col("n"), plain, F.col("brand"))
    pages = counts.where("key <> ''").groupBy("key").agg(F.min_by("brand", order).alias("brand"), F.sum("n").alias("offers"), F.array_join(F.array_sort(F.collect_set("brand")), "|").alias("variants"))
    return pages.where("offers >= 2").select("brand", F.concat("key", F.lit("-wholesale")).alias("slug"), "offers", "variants")


@query("a5_canonical_representative", "SELECT ord, first_value(ord) OVER (PARTITION BY name, spec ORDER BY delisted, CASE stock WHEN 'in' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, coalesce(qty, 0) DESC, amount ASC NULLS LAST, ord) AS canonical FROM offers", "offers")
def canonical_representative(o):
    """The row that stands for all rows with one name and pack size: live, in stock, deep,
    cheap, first. The best is aggregated map-side and joined back."""
    rank = F.struct("delisted", F.when(F.col("stock") == "in", 0).when(F.col("stock") == "warn", 1).otherwise(2), -F.coalesce("qty", F.lit(0)), F.col("amount").isNull(), F.coalesce("amount", F.lit(0.0)), F.col("ord"))
    best = o.groupBy("name", "spec").agg(F.min_by("ord", rank).alias("canonical"))
    return o.select("ord", "name", "spec").join(best, ["name", "spec"]).select("ord", "canonical")


@query("a6_floor_prices", "SELECT CASE WHEN price_basis IN ('case', 'pack') THEN 'case' ELSE 'unit' END AS basis, currency, min(amount) AS floor FROM offers WHERE amount IS NOT NULL GROUP BY 1, 2", "offers")
def floor_prices(o):
    basis = F.when(F.col("price_basis").isin("case", "pack"), F.lit("case")).otherwise(F.lit("unit"))
    return o.where("amount IS NOT NULL").groupBy(basis.alias("basis"), "currency").agg(F.min("amount").alias("floor"))


@query("a7_a9_a10_category_rollup", "SELECT category, count(*) AS n, count(*) FILTER (WHERE stock = 'in') AS in_stock, count(*) FILTER (WHERE tier IN ('T1', 'Bonded')) AS bonded, array_to_string(list_sort(list_distinct(list(volume_ml) FILTER (WHERE volume_ml IS NOT NULL))), ',') AS sizes, CASE WHEN count(DISTINCT pack) = 1 THEN max(pack) END AS one_pack FROM offers GROUP BY category", "offers")
def category_rollup(o):
    return o.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("stock") == "in").alias("in_stock"),
        F.count_if(F.col("tier").isin("T1", "Bonded")).alias("bonded"),
        F.array_join(F.array_sort(F.collect_set("volume_ml")).cast("array<string>"), ",").alias("sizes"),
        F.when(F.countDistinct("pack") == 1, F.max("pack")).alias("one_pack"),
    )


@query("a8_t6_top_brands", "SELECT brand, n, row_number() OVER (ORDER BY n DESC, brand) AS r FROM (SELECT brand, count(*) AS n FROM offers WHERE brand <> '' GROUP BY brand) QUALIFY r <= 24", "offers")
def top_brands(o):
    top = o.where("brand <> ''").groupBy("brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "brand").limit(24)
    return top.withColumn("r", numbered(Window.orderBy(F.desc("n"), "brand")))


@query("a22_letter_groups", "SELECT CASE WHEN regexp_matches(brand, '^[A-Za-z]') THEN upper(brand[1:1]) ELSE '#' END AS letter, count(DISTINCT brand) AS brands FROM offers GROUP BY 1", "offers")
def letter_groups(o):
    first = F.upper(F.left("brand", F.lit(1)))
    return o.groupBy(F.when(first.rlike("^[A-Z]"), first).otherwise(F.lit("#")).alias("letter")).agg(F.countDistinct("brand").alias("brands"))


@query("a23_privilege_audit", "SELECT segment, string_agg(DISTINCT country, ', ' ORDER BY country) AS countries FROM contacts WHERE country <> '' GROUP BY segment", "contacts")
def privilege_audit(c):
    return c.where("country <> ''").groupBy("segment").agg(F.array_join(F.array_sort(F.collect_set("country")), ", ").alias("countries"))


@query("a24_first_row_wins", "SELECT name, min_by(currency, ord) AS currency FROM offers WHERE featured GROUP BY name", "offers")
def first_row_wins(o):
    return o.where("featured").groupBy("name").agg(F.min_by("currency", "ord").alias("currency"))


@query("a21_a25_price_bounds", "SELECT lower(brand) AS k, floor(min(amount)) AS lo, ceil(max(amount)) AS hi, min(amount) AS low, min_by(currency, ord) FILTER (WHERE amount IS NOT NULL) AS label FROM offers WHERE brand <> '' GROUP BY 1", "offers")
def price_bounds(o):
    priced = F.when(F.col("amount").isNotNull(), F.col("ord"))
    return o.where("brand <> ''").groupBy(F.lower("brand").alias("k")).agg(F.floor(F.min("amount")).cast("double").alias("lo"), F.ceil(F.max("amount")).cast("double").alias("hi"), F.min("amount").alias("low"), F.min_by("currency", priced).alias("label"))


@query("t1_t5_home_window", "SELECT ord, row_number() OVER (ORDER BY featured DESC, CASE stock WHEN 'in' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, CASE WHEN stock = 'in' THEN coalesce(qty, 0) ELSE 0 END DESC, ord) AS r FROM offers WHERE NOT delisted QUALIFY r <= 48", "offers")
def home_window(o):
    order = [F.desc("featured"), F.when(F.col("stock") == "in", 0).when(F.col("stock") == "warn", 1).otherwise(2), F.desc(F.when(F.col("stock") == "in", F.coalesce("qty", F.lit(0))).otherwise(0)), F.col("ord")]
    top = o.where("NOT delisted").orderBy(*order).limit(48)
    return top.select("ord", numbered(Window.orderBy(*order)).alias("r"))


@query("t2_price_sort", "SELECT ord, row_number() OVER (ORDER BY amount IS NULL, CASE WHEN amount IS NULL THEN '' ELSE currency END, amount DESC, ord) AS r FROM offers QUALIFY r <= 50", "offers")
def price_sort(o):
    """Unpriced last, then currency, then price; the first page."""
    order = [F.col("amount").isNull(), F.when(F.col("amount").isNotNull(), F.col("currency")).otherwise(F.lit("")), F.col("amount").desc_nulls_last(), F.col("ord")]
    return o.orderBy(*order).limit(50).select("ord", numbered(Window.orderBy(*order)).alias("r"))


@query("t3_t4_t8_newest_page", "SELECT ord, row_number() OVER (ORDER BY offer_date DESC, ord) AS r FROM offers QUALIFY r > 50 AND r <= 100", "offers")
def newest_page(o):
    order = [F.desc("offer_date"), F.col("ord")]
    top = o.orderBy(*order).limit(100).select("ord", numbered(Window.orderBy(*order)).alias("r"))
    return top.where("r > 50")


@query("t7_t12_category_top", "SELECT category, brand, n, r FROM (SELECT category, brand, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS r FROM offers WHERE brand <> '' GROUP BY category, brand) WHERE r <= 5", "offers")
def category_top(o):
    counts = o.where("brand <> ''").groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", numbered(Window.partitionBy("category").orderBy(F.desc("n"), "brand"))).where("r <= 5")


@query("u1_u5_set_operations", "SELECT id, min(src) AS src FROM (SELECT id, 0 AS src FROM offers_next UNION ALL SELECT id, 1 FROM offers_prev) GROUP BY id", "offers_prev", "offers_next")
def set_operations(prev, new):
    """A union in which today's row wins over yesterday's of the same id."""
    both = new.select("id", F.lit(0).alias("src")).unionByName(prev.select("id", F.lit(1).alias("src")))
    return both.groupBy("id").agg(F.min("src").alias("src"))


@query("u3_u4_difference_intersection", "SELECT id, 'removed' AS kind FROM offers_prev WHERE id NOT IN (SELECT id FROM offers_next) UNION ALL SELECT id, 'kept' FROM offers_prev WHERE id IN (SELECT id FROM offers_next)", "offers_prev", "offers_next")
def difference_intersection(prev, new):
    gone = prev.join(new, "id", "left_anti").select("id", F.lit("removed").alias("kind"))
    return gone.union(prev.join(new, "id", "left_semi").select("id", F.lit("kept").alias("kind")))


@query(
    "w2_related_offers",
    """WITH c AS (SELECT ord, category, row_number() OVER (PARTITION BY category ORDER BY ord) - 1 AS p, count(*) OVER (PARTITION BY category) AS n FROM offers WHERE NOT delisted)
       SELECT a.ord, b.ord AS related, CAST(k AS INT) AS place FROM c a CROSS JOIN range(1, 5) t(k) JOIN c b ON b.category = a.category AND b.p = (a.p + k) % a.n WHERE k < a.n""",
    "offers",
)
def related_offers(o):
    """Each offer's next four in its category, round the end."""
    live = o.where("NOT delisted").select("ord", "category")
    rank = ranked(live, "category", "ord", "p").withColumn("p", F.col("p") - 1)
    sized = rank.join(live.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category")
    wanted = sized.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("place < n")
    wanted = wanted.select("ord", "category", "place", ((F.col("p") + F.col("place")) % F.col("n")).cast("int").alias("p"))
    return wanted.join(rank.withColumnRenamed("ord", "related"), ["category", "p"]).select("ord", "related", "place")


@query("w1_slug_suffixes", "SELECT ord, CASE WHEN r = 1 THEN s ELSE s || '-' || CAST(r AS STRING) END AS slug FROM (SELECT ord, s, row_number() OVER (PARTITION BY s ORDER BY ord) AS r FROM (SELECT ord, replace(name, ' ', '-') AS s FROM offers))", "offers")
def slug_suffixes(o):
    """Equal slugs get -2, -3 in catalogue order. Natural slugs here never end in a number;
    operators.slugs.deduped() folds those that do."""
    named = o.select("ord", brands.slug(F.col("name")).alias("s"))
    return ranked(named, "s", "ord", "r").select("ord", F.when(F.col("r") == 1, F.col("s")).otherwise(F.concat_ws("-", "s", F.col("r").cast("string"))).alias("slug"))
