"""The site that the catalogue makes: map, redirects, ledger, related lines, page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import brands, intake, offers
from tradewind.operators import intake_payload, site
from tradewind.plans import lifecycle
from tradewind.plans.catalogue import canonical_representative
from tradewind.plans.registry import query

#: Where the queries' site is, and when it was built.
ORIGIN, BUILT = "https://shop.example", "2024-02-01"
#: Pages that no row makes.
OTHERS = [("/quote/", "monthly", "0.8"), ("/guides/", "weekly", "0.7"), ("/about/", "monthly", "0.6")]

_PAGES = """named AS (SELECT *, replace(replace(name, 'é', 'e') || ' ' || spec, ' ', '-') AS base, replace(replace(name, 'é', '') || ' ' || spec, ' ', '-') AS old_base, replace(replace(lower(brand), '#', ''), 'á', 'a') AS bkey FROM site_offers),
    placed AS (SELECT *, base || CASE WHEN r = 1 THEN '' ELSE '-' || CAST(r AS STRING) END AS slug, old_base || CASE WHEN q = 1 THEN '' ELSE '-' || CAST(q AS STRING) END AS legacy_slug
        FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY delisted, ord) AS r, row_number() OVER (PARTITION BY old_base ORDER BY delisted, ord) AS q FROM named)),
    brand_list AS (SELECT bkey, bkey || '-wholesale' AS slug FROM named WHERE brand <> '' AND NOT delisted GROUP BY bkey HAVING count(*) >= 2)"""


def _brand_pages(o):
    """(slug, variants): a page for each brand with two live lines or more."""
    counts = o.where("brand <> '' AND NOT delisted").groupBy("brand").agg(F.count(F.lit(1)).alias("n")).withColumn("key", brands.slug(F.col("brand")))
    pages = counts.where("key <> ''").groupBy("key").agg(F.sum("n").alias("n"), F.collect_set("brand").alias("variants"))
    return pages.where("n >= 2").select(F.concat("key", F.lit("-wholesale")).alias("slug"), "variants")


def _listed(o):
    """Pages with the slug of the row that stands for each."""
    placed = site.pages(o)
    stands = canonical_representative(o).join(placed.select(F.col("ord").alias("canonical"), F.col("slug").alias("canonical_slug")), "canonical")
    return placed.join(stands.select("ord", "canonical_slug"), "ord", "left")


@query(
    "s16_sitemap",
    f"""WITH {_PAGES},
        stands AS (SELECT ord, first_value(ord) OVER (PARTITION BY name, spec ORDER BY delisted, CASE stock WHEN 'in' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, coalesce(qty, 0) DESC, amount ASC NULLS LAST, ord) AS canonical FROM site_offers),
        listed AS (SELECT p.*, c.slug AS canonical_slug FROM placed p JOIN stands s ON s.ord = p.ord JOIN placed c ON c.ord = s.canonical),
        entries AS (
            SELECT 1 AS list, '/' AS path, 'daily' AS freq, '1.0' AS weight
            UNION ALL SELECT 2, '/category/' || replace(lower(category), ' ', '-') || '/', 'daily', '0.9' FROM (SELECT DISTINCT category FROM listed WHERE NOT delisted AND category <> '')
            UNION ALL SELECT 3, '/brands/', 'daily', '0.8'
            UNION ALL SELECT 4, '/brands/' || slug || '/', 'daily', '0.7' FROM brand_list
            UNION ALL SELECT 5, '/offers/' || slug || '/', 'daily', '0.8' FROM (SELECT DISTINCT canonical_slug AS slug FROM listed WHERE NOT delisted)
            UNION ALL SELECT 6, '/offers/' || slug || '/', 'monthly', '0.3' FROM listed WHERE delisted AND canonical_slug = slug
            UNION ALL SELECT 7, '/quote/', 'monthly', '0.8' UNION ALL SELECT 8, '/guides/', 'weekly', '0.7' UNION ALL SELECT 9, '/about/', 'monthly', '0.6')
       SELECT list, '  <url>' || chr(10) || '    <loc>{ORIGIN}' || replace(path, '&', '&amp;') || '</loc>' || chr(10) || '    <lastmod>{BUILT}</lastmod>' || chr(10) || '    <changefreq>' || freq || '</changefreq>' || chr(10) || '    <priority>' || weight || '</priority>' || chr(10) || '  </url>' AS line FROM entries""",
    "site_offers",
)
def sitemap(o):
    """All entries of the site map: home, categories, brands, live and archived pages, others."""
    return site.sitemap(_listed(o), _brand_pages(o), OTHERS).select("list", site.sitemap_entry(ORIGIN, BUILT).alias("line"))


@query(
    "s17_redirect_file",
    f"""WITH {_PAGES},
        spelled AS (SELECT brand, any_value(bkey) AS bkey, replace(replace(lower(brand), '#', ''), 'á', '') || '-wholesale' AS old_base FROM named WHERE brand <> '' AND NOT delisted GROUP BY brand HAVING count(*) >= 2),
        old_pages AS (SELECT bkey, old_base || CASE WHEN r = 1 THEN '' ELSE '-' || CAST(r AS STRING) END AS old FROM (SELECT *, row_number() OVER (PARTITION BY old_base ORDER BY brand DESC) AS r FROM spelled)),
        rules AS (
            SELECT 1 AS section, '/offers/' || legacy_slug || '/' AS source, '/offers/' || slug || '/' AS target FROM placed WHERE legacy_slug <> slug AND legacy_slug NOT IN (SELECT slug FROM placed)
            UNION ALL SELECT 2, '/brands/' || old || '/', '/brands/' || b.slug || '/' FROM old_pages JOIN brand_list b USING (bkey) WHERE old <> b.slug AND old NOT IN (SELECT slug FROM brand_list)),
        every AS (SELECT * FROM rules UNION ALL SELECT 3, source, target FROM ({lifecycle.REDIRECTS}) WHERE source NOT IN (SELECT source FROM rules))
       SELECT section, source || ' ' || target || ' 301' AS line FROM every
       UNION ALL SELECT section, rtrim(source, '/') || ' ' || target || ' 301' FROM every WHERE section < 3""",
    "site_offers",
    "offers_prev",
    "offers_next",
)
def redirect_file(o, prev, new):
    """Redirects of old slugs, old brand pages and retired pages, with slash-less twins."""
    return site.redirect_lines(site.moved(site.pages(o), _brand_pages(o), lifecycle.redirects(prev, new)))


@query("s18_ledger_file", f"""SELECT slug, '"' || slug || '":["' || brand || '","' || category || '","' || retired_on || '"]' AS line FROM ({lifecycle._LEDGER})""", "offers_prev", "offers_next")
def ledger_file(prev, new):
    """The ledger after a day, one entry a line; readers.write_ordered() keeps them by slug."""
    return site.ledger_lines(lifecycle.ledger(prev, new))


@query(
    "w2_related_ranked",
    f"""WITH {_PAGES},
        live AS (SELECT ord, lower(trim(brand)) AS b, category, row_number() OVER (PARTITION BY category ORDER BY ord) - 1 AS p, count(*) OVER (PARTITION BY category) AS n FROM placed WHERE NOT delisted),
        own AS (SELECT p.ord, lower(trim(p.brand)) AS b, p.category, p.delisted, l.p AS p, CASE WHEN p.delisted THEN list_sum(list_transform(string_split(p.slug, ''), lambda c: ord(c))) ELSE l.p END AS turn FROM placed p LEFT JOIN live l USING (ord)),
        same AS (SELECT o.ord, l.ord AS line, row_number() OVER (PARTITION BY o.ord ORDER BY l.ord) AS k FROM own o JOIN live l ON o.b <> '' AND l.b = o.b AND l.ord <> o.ord QUALIFY k <= 4),
        others AS (SELECT o.ord, o.turn, l.ord AS line, row_number() OVER (PARTITION BY o.ord ORDER BY l.ord) - 1 AS seat, count(*) OVER (PARTITION BY o.ord) AS n FROM own o JOIN live l ON l.category = o.category AND l.ord <> o.ord),
        turned AS (SELECT ord, line, k FROM (SELECT *, CAST((seat - turn % n + n) % n AS BIGINT) AS k FROM others) WHERE k < 8),
        joined AS (SELECT ord, line, k, 0 AS part FROM same UNION ALL SELECT ord, line, k, 1 FROM turned t WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.ord = t.ord AND s.line = t.line))
       SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY part, k) - 1 AS INT) AS place, line AS related FROM joined QUALIFY place < 4""",
    "site_offers",
)
def related_ranked(o):
    """Same brand first, then the category from the row's own place on."""
    return site.related(site.pages(o))


_MINIMUM = "CASE category WHEN 'Spirits' THEN 'EUR 5,000 minimum order' WHEN 'Beer' THEN 'Full truck load (FTL)' ELSE '' END"
_AND = "CASE WHEN len({0}) <= 1 THEN array_to_string({0}, '') ELSE array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[len({0})] END"


@query(
    "f35_f56_brand_facts",
    f"""WITH {_PAGES},
        mine AS (SELECT *, CASE WHEN price_basis IN ('case', 'pack') THEN 'case' ELSE 'bottle or unit' END AS unit, {_MINIMUM} AS house FROM named WHERE NOT delisted AND bkey IN (SELECT bkey FROM brand_list)),
        floors AS (SELECT bkey, list(t ORDER BY unit DESC, first) AS l FROM (SELECT bkey, unit, min(ord) AS first, currency || ' ' || format('{{:.2f}}', min(amount)) || ' per ' || unit AS t FROM mine WHERE amount IS NOT NULL GROUP BY bkey, unit, currency) GROUP BY bkey),
        stores AS (SELECT bkey, list(warehouse ORDER BY n DESC, warehouse)[1:3] AS l FROM (SELECT bkey, warehouse, count(*) AS n FROM mine WHERE warehouse <> '' GROUP BY 1, 2) GROUP BY bkey),
        codes AS (SELECT bkey, list(incoterm ORDER BY n DESC, incoterm)[1] AS c FROM (SELECT bkey, incoterm, count(*) AS n FROM mine WHERE incoterm <> '' GROUP BY 1, 2) GROUP BY bkey),
        volumes AS (SELECT bkey, list(CASE WHEN v >= 1000 THEN CAST(v / 1000 AS STRING) || 'L' WHEN v % 10 = 0 THEN CAST(v // 10 AS STRING) || 'cl' ELSE CAST(v AS STRING) || 'ml' END ORDER BY v) AS l FROM (SELECT DISTINCT bkey, volume_ml AS v FROM mine WHERE volume_ml > 0) GROUP BY bkey)
       SELECT b.slug, count(*) AS offers, count(*) FILTER (WHERE tier IN ('T1', 'Bonded')) AS under_bond, count(*) FILTER (WHERE tier IN ('T2', 'Duty Paid')) AS duty_paid, {_AND.format('any_value(f.l)')} AS floors, {_AND.format('any_value(s.l)')} AS places,
        any_value(c.c) AS incoterm, {_AND.format('any_value(v.l)[1:10]')} AS sizes, greatest(any_value(len(v.l)) - 10, 0) AS more_sizes, CASE WHEN count(DISTINCT house) = 1 THEN nullif(max(house), '') END AS minimum
       FROM mine m JOIN brand_list b ON b.bkey = m.bkey LEFT JOIN floors f ON f.bkey = m.bkey LEFT JOIN stores s ON s.bkey = m.bkey LEFT JOIN codes c ON c.bkey = m.bkey LEFT JOIN volumes v ON v.bkey = m.bkey GROUP BY b.slug""",
    "site_offers",
)
def brand_facts(o):
    """What each brand's page says of all its live lines."""
    key = F.concat(brands.slug(F.col("brand")), F.lit("-wholesale"))
    facts = site.brand_facts(o.where("NOT delisted AND brand <> ''"), key, intake.house_minimum(F.col("category")))
    facts = facts.where("offers >= 2").withColumnRenamed("key", "slug")
    return facts.withColumns({c: offers.list_join(F.col(c)) for c in ("floors", "places", "sizes")})


@query(
    "f58_category_texts",
    """WITH counted AS (SELECT category, brand, count(*) AS n FROM site_offers WHERE NOT delisted AND brand <> '' GROUP BY 1, 2), top AS (SELECT category, count(*) AS n, list(brand ORDER BY n DESC, brand)[1:4] AS l FROM counted GROUP BY 1),
        tiers AS (SELECT category, list_sort(list(DISTINCT tier))[1:3] AS l FROM site_offers WHERE NOT delisted AND tier <> '' GROUP BY 1)
       SELECT o.category, left(concat_ws(' · ', CAST(count(*) AS STRING) || ' wholesale ' || lower(o.category) || ' offers', CAST(any_value(t.n) AS STRING) || ' brands including ' || """
    + _AND.format("any_value(t.l)") + " , " + _AND.format("any_value(d.l)") + """ || ' duty status', 'by the case and pallet'), 300) AS description
       FROM site_offers o LEFT JOIN top t ON t.category = o.category LEFT JOIN tiers d ON d.category = o.category WHERE NOT o.delisted GROUP BY o.category""",
    "site_offers",
)
def category_texts(o):
    """A search result's text for each category: lines, brands and duty states that it has."""
    live = o.where("NOT delisted")
    counted = live.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("brand") != "", F.struct((-F.col("n")).alias("n"), "brand"))
    top = counted.groupBy("category").agg(F.sum("n").alias("lines"), F.count(named).alias("n_brands"), F.slice(F.array_sort(F.collect_list(named)), 1, 4).alias("top"))
    tiers = live.groupBy("category").agg(F.slice(F.array_sort(F.collect_set(F.nullif("tier", F.lit("")))), 1, 3).alias("tiers"))
    several = F.when(F.col("n_brands") > 0, F.concat("n_brands", F.lit(" brands including "), offers.list_join(F.transform("top", lambda x: x["brand"]))))
    duty = F.when(F.size("tiers") > 0, F.concat(offers.list_join(F.col("tiers")), F.lit(" duty status")))
    parts = [F.concat("lines", F.lit(" wholesale "), F.lower("category"), F.lit(" offers")), several, duty, F.lit("by the case and pallet")]
    return top.join(tiers, "category").select("category", offers.description(parts).alias("description"))


@query(
    "f58_offer_texts",
    """SELECT ord, left(concat_ws(' · ', 'Buy ' || name || ' (' || spec || ') wholesale', CASE WHEN amount IS NULL THEN 'price on enquiry' ELSE currency || ' ' || format('{:.2f}', amount) || ' per ' || price_basis END,
        nullif(tier, ''), nullif(incoterm, ''), 'origin ' || origin, CASE stock WHEN 'in' THEN CASE WHEN qty > 0 THEN CAST(qty AS STRING) || ' cases in stock' ELSE 'in stock' END WHEN 'warn' THEN 'limited availability' ELSE 'enquire for availability' END), 300) AS description
       FROM site_offers WHERE NOT delisted""",
    "site_offers",
)
def offer_texts(o):
    """A search result's text for each live page."""
    first = F.concat(F.lit("Buy "), "name", F.coalesce(F.concat(F.lit(" ("), F.nullif("spec", F.lit("")), F.lit(")")), F.lit("")), F.lit(" wholesale"))
    price = offers.price_label(F.col("amount"), F.col("currency"), F.col("price_basis"))
    parts = [first, price, F.col("tier"), F.col("incoterm"), F.concat(F.lit("origin "), "origin"), offers.stock_phrase(F.col("delisted"), F.col("stock"), F.col("qty"))]
    return o.where("NOT delisted").select("ord", offers.description(parts).alias("description"))


_PROPERTY = """CASE WHEN {1} THEN '{{"@type":"PropertyValue","name":"{0}","value":"' || {2} || '"}}' END"""


@query(
    "f51_product_data",
    f"""WITH {_PAGES} SELECT ord, '{{"@context":"https://schema.org","@type":"Product","name":"' || name || '","url":"{ORIGIN}/offers/' || slug || '/","description":"' || trim(name || ' ' || spec || ', ' || CASE WHEN tier = '' THEN 'wholesale' ELSE tier END || '. ' || price_detail) || '"'
        || CASE WHEN brand = '' THEN '' ELSE ',"brand":{{"@type":"Brand","name":"' || brand || '"}}' END || ',"category":"' || category || '"'
        || CASE WHEN amount IS NULL THEN '' ELSE ',"offers":{{"@type":"Offer","price":"' || format('{{:.2f}}', amount) || '","priceCurrency":"' || currency || '"' || CASE WHEN delisted THEN ',"availability":"https://schema.org/SoldOut"' WHEN stock = 'in' THEN ',"availability":"https://schema.org/InStock"' WHEN stock = 'warn' THEN ',"availability":"https://schema.org/LimitedAvailability"' ELSE '' END
            || ',"itemCondition":"https://schema.org/NewCondition","businessFunction":"http://purl.org/goodrelations/v1#Sell","eligibleCustomerType":"http://purl.org/goodrelations/v1#Business","eligibleQuantity":{{"@type":"QuantitativeValue","unitText":"' || CASE WHEN price_basis IN ('case', 'pack') THEN 'case' ELSE 'unit' END || '","minValue":1}},"seller":{{"@id":"{ORIGIN}/#org"}}'
            || CASE WHEN delisted THEN '' ELSE ',"priceValidUntil":"2024-02-15"' END || '}}' END
        || ',"additionalProperty":[' || concat_ws(',', {_PROPERTY.format('Pack size', 'true', 'spec')}, {_PROPERTY.format('Duty status', "tier <> ''", 'tier')}, {_PROPERTY.format('Incoterm', "incoterm <> ''", 'incoterm')}, {_PROPERTY.format('Stock', 'qty > 0 AND NOT delisted', "CAST(qty AS STRING) || ' cases'")}, {_PROPERTY.format('Origin', 'origin IS NOT NULL', 'origin')}) || ']}}' AS data
       FROM placed""",
    "site_offers",
)
def product_data(o):
    """Each page's product as JSON-LD."""
    until = F.date_add(F.lit(BUILT).cast("date"), 14)
    rows = site.pages(o).withColumn("terms", F.col("incoterm"))
    return rows.select("ord", offers.product_data(ORIGIN, until).alias("data"))


@query(
    "q11_quote_views",
    """WITH result AS (SELECT result_id, CASE WHEN json_type(result, '$.fields') = 'OBJECT' THEN json_extract(result, '$.fields') ELSE result::JSON END AS j FROM service_results),
        rows AS (SELECT result_id, unnest(from_json(json_extract(j, '$.results'), '["JSON"]')) AS r, generate_subscripts(from_json(json_extract(j, '$.results'), '["JSON"]'), 1) - 1 AS n FROM result),
        read AS (SELECT result_id, n, coalesce((r->>'$.needsReview') = 'true', false) AS review, json_type(r, '$.match') = 'OBJECT' AS matched, try_cast(r->>'$.customerPriceBase' AS DOUBLE) - try_cast(r->>'$.wholesalePrice' AS DOUBLE) AS saving FROM rows)
       SELECT view, result_id, CAST(n AS INT) AS n, saving FROM (SELECT 'all' AS view, * FROM read UNION ALL SELECT 'review', * FROM read WHERE review UNION ALL SELECT 'saving', * FROM read WHERE saving > 0 UNION ALL SELECT 'unmatched', * FROM read WHERE matched IS NOT TRUE)""",
    "service_results",
)
def quote_views(s):
    """A quote's lines in each view that a buyer can choose, from one scan."""
    return intake_payload.views(s.select("result_id", F.posexplode(intake_payload.quoted(intake_payload.parsed(F.col("result")))).alias("n", "q")))


@query(
    "s12_public_listing",
    """SELECT p_partkey AS ord, CASE WHEN p_partkey % 7 IN (0, 1, 2) AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 1 AND p_retailprice < 1500 AND p_size > 5 THEN 'Yes' ELSE 'No' END AS listed FROM part""",
    "part",
)
def public_listing(part):
    """Which rows are listed, by status, expiry, approval and two checks, unknown ones too."""
    status = F.expr("CASE p_partkey % 7 WHEN 0 THEN 'Live' WHEN 1 THEN 'Broadcasted' WHEN 2 THEN 'Sent' WHEN 3 THEN 'Draft' WHEN 4 THEN '' END")
    expired, approval = F.expr("CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END"), F.expr("CASE p_partkey % 3 WHEN 1 THEN NULL ELSE 'Approved' END")
    return part.select(F.col("p_partkey").alias("ord"), offers.publicly_listed(status, expired, approval, F.col("p_retailprice") < 1500, F.expr("CASE WHEN p_size > 5 THEN true END")).alias("listed"))
