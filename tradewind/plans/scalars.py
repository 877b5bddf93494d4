"""Scalar functions as queries over the catalogue view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import brands, offers
from tradewind.functions.js import half_up
from tradewind.plans.registry import query


@query("f13_f14_brand_cleaning", "SELECT ord, CASE WHEN lower(trim(b)) IN ('zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','a','an') THEN '' ELSE trim(b) END AS clean, length(regexp_replace(b, '[^A-Za-z]', '', 'g')) > 1 AND regexp_replace(b, '[^A-Za-z]', '', 'g') = upper(regexp_replace(b, '[^A-Za-z]', '', 'g')) AS shouting FROM (SELECT ord, CASE WHEN ord % 5 = 0 THEN ' two ' ELSE brand END AS b FROM offers)", "offers")
def brand_cleaning(o):
    b = F.when(F.col("ord") % 5 == 0, F.lit(" two ")).otherwise(F.col("brand"))
    return o.select("ord", brands.clean_brand(b).alias("clean"), brands.is_shouting(b).alias("shouting"))


@query(
    "f3_f4_f5_volumes",
    "SELECT ord, CAST(regexp_extract(spec, 'x ([0-9]+)ml', 1) AS INT) AS spec_ml, CASE WHEN ml IS NULL OR ml <= 0 THEN '' WHEN ml >= 1000 AND ml % 100 = 0 THEN rtrim(rtrim(printf('%.2f', ml / 1000.0), '0'), '.') || 'L' ELSE CAST(ml AS STRING) || 'ml' END AS label, CAST(ml2 AS INT) AS text_ml FROM (SELECT *, volume_ml * 5 AS ml, CASE ord % 3 WHEN 0 THEN 700 WHEN 1 THEN 1500 ELSE 330 END AS ml2 FROM offers)",
    "offers",
)
def volumes(o):
    text = F.when(F.col("ord") % 3 == 0, F.lit("5 kg, 6 x 70cl x 40%")).when(F.col("ord") % 3 == 1, F.lit("box 1,5 litres")).otherwise(F.lit("0ml 330 ML can"))
    return o.select("ord", offers.volume_ml(F.col("spec")).alias("spec_ml"), offers.volume_label(F.col("volume_ml") * 5).alias("label"), offers.volume_ml(text).alias("text_ml"))


@query("f11_f12_j8_barcodes", "SELECT ord, ltrim(ean, '0') AS key_unit, nullif(ltrim(ean_case, '0'), '') AS key_case FROM offers WHERE (ean <> '' AND TRY_CAST(ltrim(ean, '0') AS BIGINT) IN (SELECT 50000000 + ord FROM offers WHERE ord % 6 = 0)) OR (ean_case <> '' AND TRY_CAST(ean_case AS BIGINT) IN (SELECT 50000000 + ord FROM offers WHERE ord % 6 = 0))", "offers")
def barcodes(o):
    """Rows one of whose barcodes is in a list of keys; the list is a table, not a literal."""
    wanted = o.where("ord % 6 = 0").select((F.col("ord") + 50000000).cast("string").alias("key"))
    keyed = o.select("ord", brands.ean_key(F.col("ean")).alias("key_unit"), brands.ean_key(F.col("ean_case")).alias("key_case"))
    hits = keyed.select("ord", F.explode(F.array("key_unit", "key_case")).alias("key")).join(wanted, "key", "left_semi").select("ord").distinct()
    out = keyed.join(hits, "ord", "left_semi")
    return out.select("ord", F.coalesce("key_unit", F.lit("")).alias("key_unit"), "key_case")


@query(
    "f19_f20_f21_price_parsing",
    "SELECT ord, amount AS headline, currency AS part_currency, price_basis AS basis, amount / pack AS second, pack AS pack_size, CAST(CAST(ord * 1000 AS STRING) || '.5' AS DOUBLE) AS bare FROM (SELECT ord, CAST(CAST(ord AS STRING) || '.25' AS DOUBLE) * pack AS amount, currency, price_basis, pack FROM offers)",
    "offers",
)
def price_parsing(o):
    each = F.concat(F.col("ord").cast("string"), F.lit(".25")).cast("double")
    detail = F.concat(F.col("currency"), F.lit(" "), (each * F.col("pack")).cast("decimal(18,2)").cast("string"), F.lit("/"), F.col("price_basis"), F.lit(" ("), F.col("pack").cast("string"), F.lit("pk) · "), F.col("currency"), F.lit(" "), each.cast("decimal(18,2)").cast("string"), F.lit("/unit"))
    parts = offers.price_parts(detail)
    grouped = F.concat(F.format_number(F.col("ord") * 1000, 0), F.lit(".5"))
    return o.select("ord", parts[0]["amount"].alias("headline"), parts[0]["currency"].alias("part_currency"), parts[0]["basis"].alias("basis"), parts[1]["amount"].alias("second"), offers.pack_size(detail, F.col("spec")).cast("long").alias("pack_size"), offers.amount(F.concat(F.lit("EUR "), grouped)).alias("bare"))


@query("f15_f16_names", "SELECT ord, CASE WHEN ord % 2 = 0 AND length(name) >= 8 THEN name WHEN ord % 2 = 0 THEN name || ' — a, b, c' ELSE name || ' special' END AS clean, CASE WHEN ord % 2 = 0 AND length(name) >= 8 THEN 'a, b, c' ELSE '' END AS variants FROM offers", "offers")
def names(o):
    even = F.concat(F.col("name"), F.lit(" — a, b, c Price:"))
    odd = F.concat(F.col("name"), F.lit(" special , prices : ;"))
    split = offers.variants(F.when(F.col("ord") % 2 == 0, even).otherwise(odd))
    return o.select("ord", split["name"].alias("clean"), split["variants"].alias("variants"))


@query("f17_f18_p8_s7_terms_units_stock", "SELECT ord, incoterm, warehouse, CASE ord % 6 WHEN 0 THEN 'Can' WHEN 1 THEN 'Bottle' WHEN 2 THEN 'Jar' WHEN 3 THEN 'Sachet' WHEN 4 THEN 'Tube' ELSE '' END AS unit, CASE ord % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'warn' ELSE 'enq' END AS code FROM offers WHERE ord % 40 <> 0", "offers")
def terms_units_stock(o):
    text = F.element_at(F.array(*map(F.lit, ("24 cans", "6 btl", "12 jars", "sachets of 5", "tube", "cannery"))), (F.col("ord") % 6 + 1).cast("int"))
    stock = F.element_at(F.array(*map(F.lit, ("In Stock now", "Limited", "ask"))), (F.col("ord") % 3 + 1).cast("int"))
    name = F.when(F.col("ord") % 40 == 0, F.concat(F.lit(" TestProduct "), "name")).otherwise(F.col("name"))
    split = offers.terms(F.concat_ws(" ", F.nullif("incoterm", F.lit("")), "warehouse"))
    return o.where(~offers.is_test_row(name)).select("ord", split["incoterm"].alias("incoterm"), split["warehouse"].alias("warehouse"), offers.unit_type(text).alias("unit"), offers.stock_code(stock).alias("code"))


@query(
    "f28_f31_trade_term_labels",
    """SELECT ord, moq_source IN ('Supplier Default', 'Category Rule') AS estimated,
         CASE WHEN moq_type = 'No Minimum' THEN 'No minimum' WHEN moq_type = 'Order Value' AND moq_qty > 0 THEN currency || ' ' || CAST(CAST(moq_qty AS INT) AS STRING)
              WHEN moq_type IN ('Pallets', 'Cases', 'Container') AND moq_qty > 0 THEN CAST(CAST(moq_qty AS INT) AS STRING) || ' ' || CASE moq_type WHEN 'Pallets' THEN 'pallet' WHEN 'Cases' THEN 'case' ELSE 'container' END || CASE WHEN moq_qty = 1 THEN '' ELSE 's' END
              WHEN moq_type = 'Container' THEN 'Container' WHEN ord % 2 = 0 THEN 'ask us' WHEN moq_type <> '' THEN 'On request' ELSE '' END AS moq,
         CASE moq_type WHEN '' THEN '' WHEN 'No Minimum' THEN 'No minimum' WHEN 'Order Value' THEN 'Minimum order value' WHEN 'Container' THEN 'Full load only' WHEN 'Pallets' THEN 'Pallet minimum' ELSE 'Unit minimum' END AS moq_group,
         CASE WHEN d IS NULL THEN '' WHEN d = 0 THEN 'Ex-stock' WHEN d = 1 THEN '1 day' WHEN d = 7 THEN '1 week' WHEN d % 7 = 0 THEN CAST(d // 7 AS STRING) || ' weeks' ELSE CAST(d AS STRING) || ' days' END AS lead,
         CASE WHEN d IS NULL THEN '' WHEN d = 0 THEN 'Ex-stock' WHEN d <= 7 THEN 'Within a week' WHEN d <= 28 THEN '1–4 weeks' ELSE 'Over 4 weeks' END AS lead_group
       FROM (SELECT *, lead_time_days AS d FROM offers)""",
    "offers",
)
def trade_term_labels(o):
    legacy = F.when(F.col("ord") % 2 == 0, F.lit(" ask us ")).otherwise(F.lit(""))
    days = F.col("lead_time_days")
    return o.select("ord", offers.is_estimated(F.col("moq_source")).alias("estimated"), offers.moq_label(F.col("moq_type"), F.col("moq_qty"), F.col("currency"), legacy).alias("moq"), offers.moq_bucket(F.col("moq_type")).alias("moq_group"), offers.lead_label(days).alias("lead"), offers.lead_bucket(days).alias("lead_group"))


@query(
    "f22_f23_f33_f52_codes",
    "SELECT ord, CASE WHEN qty > 0 THEN qty END AS cases, CASE price_basis WHEN 'unit' THEN 'unit' ELSE price_basis END AS noun, CASE WHEN tier IN ('T1', 'Bonded') THEN 'bond' WHEN tier IN ('T2', 'Duty Paid') THEN 'paid' ELSE '' END AS duty, CASE WHEN delisted THEN 'SoldOut' WHEN stock = 'in' THEN 'InStock' WHEN stock = 'warn' THEN 'LimitedAvailability' END AS availability FROM offers",
    "offers",
)
def codes(o):
    availability = F.when(F.col("delisted"), F.lit("SoldOut")).when(F.col("stock") == "in", F.lit("InStock")).when(F.col("stock") == "warn", F.lit("LimitedAvailability"))
    return o.select("ord", offers.count_or_null(F.col("qty").cast("double")).alias("cases"), offers.basis_noun(F.col("price_basis")).alias("noun"), offers.duty_class(F.col("tier")).alias("duty"), availability.alias("availability"))


@query("f25_f26_f27_slugs", "SELECT ord, regexp_replace(regexp_replace(trim(lower(strip_accents(name)) || ' ' || spec), '[^a-z0-9_ -]', '', 'g'), ' +', '-', 'g') AS slug, 'moet-loreal-strasse' AS folded, lower(category) || '-' || 'x' AS cat FROM offers", "offers")
def slugs(o):
    return o.select("ord", brands.slug(F.col("name"), F.col("spec")).alias("slug"), brands.slug(F.lit("Moët L'Oréal  Straße")).alias("folded"), brands.category_slug(F.concat(F.lit(" "), "category", F.lit("  x"))).alias("cat"))


@query("f36_f57_list_phrases", "SELECT category, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS phrase FROM (SELECT category, list_sort(list_distinct(list(currency)))[1:3] AS l FROM offers GROUP BY category)", "offers")
def list_phrases(o):
    return o.groupBy("category").agg(offers.list_join(F.slice(F.array_sort(F.collect_set("currency")), 1, 3)).alias("phrase"))


@query(
    "f37_f38_f39_terms_numbers",
    "SELECT ord, CAST(CASE ord % 5 WHEN 0 THEN 35000.0 WHEN 1 THEN 1500000.0 WHEN 2 THEN 35000.0 WHEN 3 THEN 1234.5 ELSE 12000.0 END AS DOUBLE) AS number, CAST(CASE ord % 4 WHEN 0 THEN n * 7 WHEN 1 THEN n * 30 WHEN 2 THEN ceil(n / 24.0) ELSE ceil(n * 7 / 5.0) END AS BIGINT) AS days FROM (SELECT ord, 1 + ord % 9 AS n FROM offers)",
    "offers",
)
def terms_numbers(o):
    text = F.element_at(F.array(*map(F.lit, ("35k", "1.5m", "USD 35.000", "1,234.5 eur", "12 000"))), (F.col("ord") % 5 + 1).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("weeks", "months", "hours", "days"))), (F.col("ord") % 4 + 1).cast("int"))
    return o.select("ord", offers.terms_amount(text).alias("number"), offers.to_days(1 + F.col("ord") % 9, unit, F.lit(True)).alias("days"))


@query("f40_f41_f48_f49_small_helpers", "SELECT ord, CASE WHEN offer_date = '' THEN NULL ELSE CAST(offer_date AS DATE) - 7 END AS week_before, CAST(ord AS DOUBLE) AS lenient, CASE WHEN length(name) > 8 THEN rtrim(name[1:7]) || '…' ELSE name END AS clipped, '&lt;b&gt; &amp; ' || name AS escaped FROM offers", "offers")
def small_helpers(o):
    day = F.try_to_date(F.nullif(F.regexp_extract("offer_date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("")))
    lenient = F.coalesce(F.regexp_replace(F.concat(F.lit("EUR "), F.col("ord").cast("string"), F.lit(" ca")), "[^0-9.-]", "").try_cast("double"), F.lit(0.0))
    clipped = F.when(F.length("name") > 8, F.concat(F.rtrim(F.left("name", F.lit(7))), F.lit("…"))).otherwise(F.col("name"))
    escaped = F.concat(F.lit("<b> & "), "name")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    return o.select("ord", F.date_sub(day, 7).alias("week_before"), lenient.alias("lenient"), clipped.alias("clipped"), escaped.alias("escaped"))


@query("s4_row_coercion", "SELECT ord, amount AS num, CASE WHEN featured THEN true END AS flag, nullif(offer_date, '') AS day, CASE WHEN offer_date <> '' THEN offer_date || 'T00:00:00.000Z' END AS stamp, nullif(brand, '') AS text FROM offers", "offers")
def row_coercion(o):
    """Typed columns from text: numbers, dates, true-only flags; blanks are null."""
    raw = o.select("ord", F.col("amount").cast("string").alias("a"), F.col("featured").cast("string").alias("b"), F.concat("offer_date", F.lit("T10:00")).alias("d"), "brand")
    day = F.nullif(F.regexp_extract("d", "^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))
    return raw.select("ord", F.col("a").try_cast("double").alias("num"), F.when(F.col("b") == "true", F.lit(True)).alias("flag"), day.alias("day"), F.concat(day, F.lit("T00:00:00.000Z")).alias("stamp"), F.nullif("brand", F.lit("")).alias("text"))


@query("p7_q10_derived_fields", "SELECT ord, coalesce(volume_ml, CAST(regexp_extract(spec, 'x ([0-9]+)ml', 1) AS INT)) AS volume, coalesce(CASE WHEN price_basis IN ('case', 'pack') THEN floor(amount / pack * 10000 + 0.5) / 10000 END, amount) AS price FROM offers", "offers")
def derived_fields(o):
    per_unit = F.when(F.col("price_basis").isin("case", "pack"), half_up(F.col("amount") / F.col("pack") * 10000) / 10000)
    return o.select("ord", F.coalesce("volume_ml", offers.volume_ml(F.col("spec"))).alias("volume"), F.coalesce(per_unit, F.col("amount")).alias("price"))


@query("f24_price_label", "SELECT ord, CASE WHEN amount IS NULL THEN 'price on enquiry' ELSE currency || ' ' || printf('%.2f', amount) || CASE price_basis WHEN 'case' THEN ' per case' WHEN 'unit' THEN ' per unit' WHEN 'bottle' THEN ' per bottle' ELSE ' per pack' END END AS label, CASE WHEN amount IS NULL THEN 'price on enquiry' ELSE currency || ' ' || printf('%.2f', amount) || ' / ' || price_basis END AS short FROM offers", "offers")
def price_labels(o):
    parts = F.col("amount"), F.col("currency"), F.col("price_basis")
    return o.select("ord", offers.price_label(*parts).alias("label"), offers.price_label(*parts, short=True).alias("short"))


@query(
    "f32_terms_line",
    """SELECT ord, array_to_string(list_filter([CASE WHEN m = '' THEN NULL WHEN e THEN 'MOQ typically ' || m WHEN m = 'No minimum' THEN m ELSE 'MOQ ' || m END,
         CASE WHEN l <> '' THEN 'Lead ' || l END, CASE WHEN qty > 0 THEN CAST(qty AS VARCHAR) || ' cases/pallet' WHEN pack * 100 > 0 AND qty IS NULL THEN format('{:,}', pack * 100) || ' pcs/pallet' END], lambda x: x IS NOT NULL), ' · ') AS line
       FROM (SELECT *, CASE ord % 3 WHEN 0 THEN 'No minimum' WHEN 1 THEN '5 cases' ELSE '' END AS m, ord % 4 = 0 AS e, CASE WHEN ord % 5 = 0 THEN '' ELSE '2 weeks' END AS l FROM offers)""",
    "offers",
)
def terms_lines(o):
    """Cards of terms; a pallet is told in cases where they are known, else in pieces."""
    n = F.col("ord")
    moq = F.when(n % 3 == 0, "No minimum").when(n % 3 == 1, "5 cases").otherwise("")
    pallet = offers.pallet_label(F.col("qty"), F.when(F.col("qty").isNull(), F.col("pack") * 100))
    return o.select("ord", offers.listing_terms(moq, n % 4 == 0, F.when(n % 5 == 0, "").otherwise("2 weeks"), pallet).alias("line"))


@query(
    "f53_f59_titles",
    """SELECT ord, CASE WHEN delisted THEN 'sold out — request a quote' WHEN stock = 'in' THEN CASE WHEN qty > 0 THEN CAST(qty AS VARCHAR) || ' cases in stock' ELSE 'in stock' END WHEN stock = 'warn' THEN 'limited availability' ELSE 'enquire for availability' END AS phrase,
         CASE WHEN length(name) + 90 > 114 THEN regexp_replace(left(name, 23), '[ ,;·—-]+$', '') || '…' ELSE name END AS short FROM offers""",
    "offers",
)
def titles(o):
    tail = F.lit("t" * 90)
    return o.select("ord", offers.stock_phrase(F.col("delisted"), F.col("stock"), F.col("qty")).alias("phrase"), offers.title_name(F.col("name"), tail).alias("short"))


@query(
    "p9_p10_p11_p12_links",
    """SELECT ord, CASE warehouse WHEN 'North Depot' THEN 'North' ELSE warehouse END AS place, CASE WHEN ord % 2 = 0 THEN 'rec' || lpad(CAST(ord AS VARCHAR), 14, '0') ELSE '' END AS record,
         CASE ord % 3 WHEN 0 THEN 'https://quote.example/#chat' WHEN 1 THEN 'https://quote.example/#excel' ELSE 'https://quote.example' END AS tab,
         'https://chat.example?text=' || replace(replace(CASE WHEN delisted THEN 'Hi%2C I''m looking for ' || name || ' (' || spec || ') %E2%80%94 is this or a similar line available%3F'
           ELSE 'Hi%2C I''d like a quote for ' || name || ' (' || spec || ')' || CASE WHEN amount IS NULL THEN '' ELSE ' listed at ' || currency || ' ' || printf('%.2f', amount) END || '.' END, '#', '%23'), ' ', '%20') AS link
       FROM offers""",
    "offers",
)
def links(o):
    n = F.col("ord")
    key = F.lpad(n.cast("string"), 14, "0")
    return o.select(
        "ord",
        offers.place_alias(F.col("warehouse"), {"north-depot": "North"}).alias("place"),
        offers.record_id(F.concat(F.when(n % 2 == 0, " rec").otherwise("snapshot-"), key)).alias("record"),
        offers.tab_url("https://quote.example", F.when(n % 3 == 0, "#Chat").when(n % 3 == 1, "excel").otherwise("other"), ["chat", "excel"]).alias("tab"),
        offers.enquiry_url("https://chat.example", F.col("name"), F.col("spec"), F.col("amount"), F.col("currency"), F.col("delisted")).alias("link"),
    )
