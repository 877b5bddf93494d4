"""Snapshots: difference, ledger, redirects, guards and sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import brands
from tradewind.operators.positions import positioned
from tradewind.plans.registry import query

#: Fields that two sources are compared on, entries of a ledger, and the archive's limit.
FIELDS, LEDGER, ARCHIVE = ["name", "amount", "stock", "warehouse"], 20_000, 800


@query(
    "j1_d4_two_source_compare",
    """SELECT field, count(*) AS n, min(id) AS example FROM (
        SELECT coalesce(a.id, b.id) AS id, unnest(CASE WHEN b.id IS NULL THEN ['only a'] WHEN a.id IS NULL THEN ['only b']
          ELSE list_filter([CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.amount IS DISTINCT FROM b.amount THEN 'amount' END,
            CASE WHEN a.stock IS DISTINCT FROM b.stock THEN 'stock' END, CASE WHEN a.warehouse IS DISTINCT FROM b.warehouse THEN 'warehouse' END], lambda x: x IS NOT NULL) END) AS field
        FROM offers_prev a FULL JOIN offers_next b ON a.id = b.id) GROUP BY field""",
    "offers_prev",
    "offers_next",
)
def two_source_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one source only and fields that differ, counted, with the first example."""
    left = a.select("id", F.struct(*FIELDS).alias("x"))
    right = b.select("id", F.struct(*FIELDS).alias("y"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in FIELDS]))
    kinds = F.when(F.col("y").isNull(), F.array(F.lit("only a"))).when(F.col("x").isNull(), F.array(F.lit("only b"))).otherwise(differ)
    found = left.join(right, "id", "full_outer").select("id", F.explode(kinds).alias("field"))
    return found.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("example"))


_PAGES = "SELECT DISTINCT replace(name, ' ', '-') || '-' || replace(spec, ' ', '-') AS slug, min(brand) OVER w AS brand, min(category) OVER w AS category FROM {} WINDOW w AS (PARTITION BY name, spec)"


def pages(offers: DataFrame) -> DataFrame:
    return offers.groupBy(brands.slug(F.col("name"), F.col("spec")).alias("slug")).agg(F.min("brand").alias("brand"), F.min("category").alias("category"))


def updated_ledger(ledger: DataFrame, before: DataFrame, after: DataFrame, today: str, most: int = LEDGER) -> DataFrame:
    """(slug, brand, category, retired_on): entries whose page is not live, and pages that
    went; a slug's first entry stays; the newest `most` are kept."""
    live = pages(after).select("slug")
    gone = pages(before).where("brand <> '' OR category <> ''").withColumn("retired_on", F.lit(today))
    both = ledger.withColumn("_p", F.lit(0)).unionByName(gone.withColumn("_p", F.lit(1))).join(live, "slug", "left_anti")
    first = both.groupBy("slug").agg(F.min_by(F.struct("brand", "category", "retired_on"), "_p").alias("e"))
    return first.select("slug", "e.*").orderBy(F.desc("retired_on"), "slug").limit(most)


_LEDGER = f"SELECT slug, min_by(brand, p) AS brand, min_by(category, p) AS category, min_by(retired_on, p) AS retired_on FROM (SELECT *, '2024-01-02' AS retired_on, 1 AS p FROM ({_PAGES.format('offers_prev')}) UNION ALL SELECT 'old-page-' || id, brand, category, '2023-12-01', 0 FROM offers_prev WHERE ord % 50 = 0) WHERE slug NOT IN (SELECT slug FROM ({_PAGES.format('offers_next')})) GROUP BY slug ORDER BY retired_on DESC, slug LIMIT {LEDGER}"


def _old(prev: DataFrame) -> DataFrame:
    return prev.where("ord % 50 = 0").select(F.concat(F.lit("old-page-"), "id").alias("slug"), "brand", "category", F.lit("2023-12-01").alias("retired_on"))


@query("d7_j3_j4_w8_ledger", _LEDGER, "offers_prev", "offers_next")
def ledger(prev: DataFrame, new: DataFrame) -> DataFrame:
    return updated_ledger(_old(prev), prev, new, "2024-01-02")


REDIRECTS = f"WITH led AS ({_LEDGER}) SELECT '/offers/' || slug || '/' AS source, CASE WHEN b.k IS NOT NULL THEN '/brands/' || b.k || '-wholesale/' ELSE '/category/' || lower(led.category) || '/' END AS target FROM led LEFT JOIN (SELECT replace(lower(brand), '#', '') AS k FROM offers_next WHERE brand <> '' GROUP BY 1 HAVING count(*) >= 2) b ON replace(lower(led.brand), '#', '') = b.k WHERE b.k IS NOT NULL OR led.category IN (SELECT category FROM offers_next)"


@query(
    "d8_j5_u5_redirects",
    REDIRECTS,
    "offers_prev",
    "offers_next",
)
def redirects(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Where a retired page leads: to its brand's page, else its category's, else nowhere."""
    led = updated_ledger(_old(prev), prev, new, "2024-01-02")
    keys = new.where("brand <> ''").groupBy(brands.slug(F.col("brand")).alias("b")).count().where("count >= 2").select("b")
    cats = new.select(brands.category_slug(F.col("category")).alias("c")).distinct()
    both = led.join(keys, brands.slug(F.col("brand")) == F.col("b"), "left").join(cats, brands.category_slug(F.col("category")) == F.col("c"), "left")
    target = F.coalesce(F.concat(F.lit("/brands/"), "b", F.lit("-wholesale/")), F.concat(F.lit("/category/"), "c", F.lit("/")))
    return both.where(target.isNotNull()).select(F.concat(F.lit("/offers/"), "slug", F.lit("/")).alias("source"), target.alias("target"))


@query(
    "j6_longest_prefix",
    "SELECT slug, max_by(k, length(k)) AS brand FROM (SELECT DISTINCT replace(lower(name || ' ' || spec), ' ', '-') AS slug FROM offers) JOIN (SELECT DISTINCT split_part(name, ' ', 1) AS k FROM offers UNION SELECT DISTINCT replace(name, ' ', '-') FROM offers WHERE ord % 3 = 0) ON starts_with(slug, k || '-') WHERE length(k) >= 3 GROUP BY slug",
    "offers",
)
def longest_prefix(o: DataFrame) -> DataFrame:
    """The longest key that begins a slug at a hyphen: hyphen prefixes are equi-joined."""
    slug = o.select(brands.slug(F.col("name"), F.col("spec")).alias("slug")).distinct()
    keys = o.select(F.split("name", " ")[0].alias("k")).union(o.where("ord % 3 = 0").select(brands.slug(F.col("name")))).distinct().where("length(k) >= 3")
    parts = F.split("slug", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    exploded = slug.where(F.col("slug").contains("-")).select("slug", F.explode(prefixes).alias("k"))
    return exploded.join(keys, "k").groupBy("slug").agg(F.max_by("k", F.length("k")).alias("brand"))


@query("j2_j17_brand_links", "SELECT o.ord, b.slug FROM offers o LEFT JOIN (SELECT replace(lower(brand), '#', '') AS k, replace(lower(brand), '#', '') || '-wholesale' AS slug FROM offers WHERE brand <> '' GROUP BY 1 HAVING count(*) >= 80) b ON replace(lower(o.brand), '#', '') = b.k", "offers")
def brand_links(o: DataFrame) -> DataFrame:
    key = brands.slug(F.col("brand"))
    linked = o.where("brand <> ''").groupBy(key.alias("k")).count().where("count >= 80").select("k", F.concat("k", F.lit("-wholesale")).alias("slug"))
    return o.select("ord", key.alias("k")).join(linked, "k", "left").select("ord", "slug")


@query("j15_link_integrity", "SELECT count(*) AS broken FROM offers_next WHERE id NOT IN (SELECT id FROM offers_prev)", "offers_prev", "offers_next")
def link_integrity(prev: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(prev, "id", "left_anti").agg(F.count(F.lit(1)).alias("broken"))


@query("d1_shrink_floor", "SELECT a, b, b < 0.8 * a AS refuse FROM (SELECT (SELECT count(*) FROM offers_prev) AS a, (SELECT count(*) FROM offers_next) AS b)", "offers_prev", "offers_next")
def shrink_floor(prev: DataFrame, new: DataFrame) -> DataFrame:
    both = prev.select(F.lit(0).alias("s")).union(new.select(F.lit(1)))
    return both.agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b")).withColumn("refuse", F.col("b") < 0.8 * F.col("a"))


@query("d2_leak_scan", "SELECT name, count(*) AS n FROM offers WHERE regexp_matches(name || ' ' || spec, '(?i)(small ring|postgres://|api[_-]?key)') GROUP BY name", "offers")
def leak_scan(o: DataFrame) -> DataFrame:
    text = F.to_json(F.struct("name", "spec"))
    return o.where(text.rlike("(?i)(small ring|postgres://|api[_-]?key)")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("s5_live_scan", "SELECT id, row_number() OVER (ORDER BY ord) AS r FROM offers WHERE NOT delisted", "offers")
def live_scan(o: DataFrame) -> DataFrame:
    """All live rows, with their place in catalogue order."""
    return positioned(o.where("NOT delisted").select("id", "ord"), "ord", "r").select("id", "r")


@query("s6_archive_scan", f"SELECT id FROM (SELECT * FROM offers WHERE delisted ORDER BY nullif(offer_date, '') DESC NULLS LAST, id LIMIT {ARCHIVE}) WHERE ord % 20 <> 9", "offers")
def archive_scan(o: DataFrame) -> DataFrame:
    """The newest archive rows; test rows are dropped after the limit, as in the source."""
    top = o.where("delisted").orderBy(F.nullif("offer_date", F.lit("")).desc_nulls_last(), "id").limit(ARCHIVE)
    return top.where("ord % 20 <> 9").select("id")


@query("s12_s13_listing_predicate", "SELECT id, CASE WHEN stock IN ('in', 'warn') AND amount IS NOT NULL AND offer_date <> '' THEN 'Yes' ELSE 'No' END AS listed FROM offers WHERE qty IS NOT NULL", "offers")
def listing_predicate(o: DataFrame) -> DataFrame:
    listed = F.col("stock").isin("in", "warn") & F.col("amount").isNotNull() & (F.col("offer_date") != "")
    return o.where("qty IS NOT NULL").select("id", F.when(listed, F.lit("Yes")).otherwise(F.lit("No")).alias("listed"))


@query("s14_json_index", """SELECT id, '{"id":"' || id || '","name":"' || name || '"' || CASE WHEN brand = '' THEN '' ELSE ',"brand":"' || brand || '"' END || CASE WHEN warehouse = '' THEN '' ELSE ',"warehouse":"' || warehouse || '"' END || '}' AS line FROM offers""", "offers")
def json_index(o: DataFrame) -> DataFrame:
    """One JSON object for each row, blanks left out."""
    return o.select("id", F.to_json(F.struct("id", "name", F.nullif("brand", F.lit("")).alias("brand"), F.nullif("warehouse", F.lit("")).alias("warehouse"))).alias("line"))


@query("s15_snapshot_hash", "SELECT (SELECT count(*) FROM (SELECT id, name, amount FROM offers_prev EXCEPT SELECT id, name, amount FROM offers_next)) > 0 AS changed", "offers_prev", "offers_next")
def snapshot_changed(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Whether a snapshot differs: sums of row hashes, one partial row for each task."""
    total = lambda df, k: df.select(F.lit(k).alias("k"), F.xxhash64("id", "name", "amount").cast("decimal(38,0)").alias("h"))
    sums = total(prev, 0).union(total(new, 1)).groupBy().pivot("k", [0, 1]).agg(F.sum("h"))
    return sums.select((~F.col("0").eqNullSafe(F.col("1"))).alias("changed"))


@query("s16_s17_sitemap_lines", "SELECT '<url><loc>/offers/' || slug || '/</loc></url>' AS line FROM (SELECT DISTINCT replace(name, ' ', '-') || '-' || replace(spec, ' ', '-') AS slug FROM offers WHERE NOT delisted) UNION ALL SELECT '/category/' || lower(category) || ' /c/ 301' FROM (SELECT DISTINCT category FROM offers)", "offers")
def sitemap_lines(o: DataFrame) -> DataFrame:
    urls = o.where("NOT delisted").select(brands.slug(F.col("name"), F.col("spec")).alias("s")).distinct().select(F.format_string("<url><loc>/offers/%s/</loc></url>", "s").alias("line"))
    rules = o.select(brands.category_slug(F.col("category")).alias("c")).distinct().select(F.format_string("/category/%s /c/ 301", "c").alias("line"))
    return urls.union(rules)


@query("w9_boundary_trim", "SELECT id FROM offers_next WHERE amount >= (SELECT greatest((SELECT min(amount) FROM offers_prev), (SELECT min(amount) + 5 FROM offers_next)))", "offers_prev", "offers_next")
def boundary_trim(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Rows from the later of the two sources' first values on."""
    bounds = prev.select("amount", F.lit(0).alias("s")).union(new.select("amount", F.lit(1)))
    low = bounds.agg(F.greatest(F.min(F.when(F.col("s") == 0, F.col("amount"))), F.min(F.when(F.col("s") == 1, F.col("amount"))) + 5).alias("low"))
    return new.withColumn("_j", F.lit(1)).join(F.broadcast(low.withColumn("_j", F.lit(1))), "_j").where("amount >= low").select("id")


@query("p16_price_view", "SELECT ord, price_basis AS basis, currency || ' ' || CAST(ord AS STRING) AS other FROM offers", "offers")
def price_view(o: DataFrame) -> DataFrame:
    text = F.concat_ws(" · ", F.concat_ws("/", F.concat_ws(" ", "currency", F.col("pack").cast("string")), "price_basis"), F.concat_ws(" ", "currency", F.col("ord").cast("string")))
    parts = F.split(text, " · ")
    return o.select("ord", F.regexp_extract(parts[0], "/(\\w+)\\z", 1).alias("basis"), F.array_join(F.slice(parts, 2, 9), " · ").alias("other"))


@query(
    "w3_archive_rotation",
    """SELECT ord, CAST(list_sum(list_transform(string_split(replace(lower(regexp_replace(name, '#', '')), ' ', '-'), ''), lambda c: ord(c))) % greatest(1, (SELECT count(*) FROM offers l WHERE NOT l.delisted AND l.category = o.category)) AS BIGINT) AS turn FROM offers o WHERE delisted""",
    "offers",
)
def archive_rotation(o):
    """Where a delisted offer's window of its category begins: its slug's character codes,
    summed, round the category's live offers."""
    live = o.where("NOT delisted").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    gone = o.where("delisted").select("ord", "category", brands.slug(F.col("name")).alias("s"))
    codes = F.transform(F.split("s", ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c)
    return gone.join(live, "category", "left").select("ord", (total % F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).alias("turn"))


@query("s18_ledger_lines", """SELECT '"' || id || '":"' || offer_date || '"' AS line FROM offers WHERE delisted AND offer_date <> ''""", "offers")
def ledger_lines(o):
    """The ledger of retired offers as JSON members, one a line, for readers.write_lines()."""
    member = F.to_json(F.create_map("id", "offer_date"))
    return o.where("delisted AND offer_date <> ''").select(F.substr(member, F.lit(2), F.length(member) - 2).alias("line"))
