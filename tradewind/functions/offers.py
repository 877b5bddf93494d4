"""Price, pack, size and term expressions of an offer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.js import blank, half_up, trimmed_number

#: Delivery terms that may begin a terms text.
INCOTERMS = "EXW FCA FOB CFR CIF DAP DDP DPU CPT CIP FAS".split()
#: Words of the counted minimum-order types, one and many.
UNIT_WORDS = {"Pallets": ("pallet", "pallets"), "Cases": ("case", "cases"), "Container": ("container", "containers"), "Full Truckload": ("full load", "full loads")}

#: What a price may be for, labels before a price, and words for kinds of unit.
BASES = "case unit btl bottle pack can jar piece".split()
PRICE_LABELS = ["price", "prices"]
UNIT_KINDS = {"Can": "can cans tin tins", "Bottle": "btl btls bottle bottles pet nrb", "Jar": "jar jars", "Sachet": "sachet sachets", "Tube": "tube tubes"}


def stock_code(label: Column) -> Column:
    text = F.lower(F.coalesce(label, F.lit("")))
    return F.when(text.contains("in stock"), F.lit("in")).when(text.contains("limited"), F.lit("warn")).otherwise(F.lit("enq"))


def is_test_row(name: Column) -> Column:
    text = F.trim(F.coalesce(name, F.lit("")))
    return (text == "") | text.rlike("(?i)^(testbrand|testproduct)")


def _lexemes(text: Column) -> Column:
    """Numbers, words and other marks of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9][0-9.,]*|[A-Za-z]+|[^A-Za-z0-9\\s]"), F.lit(0))


def _number(lexeme: Column) -> Column:
    """A number with commas between thousands, up to a second point."""
    return F.substring_index(F.replace(lexeme, F.lit(",")), ".", 2).try_cast("double")


def amount(text: Column) -> Column:
    """The first number of a price, thousands commas taken out."""
    return _number(F.get(F.filter(_lexemes(text), lambda x: x.rlike("^[0-9]")), F.lit(0)))


def currency(text: Column) -> Column:
    """The three capitals before the first number of a price, or empty."""
    lexemes = _lexemes(text)
    first = F.array_position(F.transform(lexemes, lambda x: x.rlike("^[0-9]")), True)
    before = F.when(first > 1, F.get(lexemes, (first - 2).cast("int")))
    return F.when(before.rlike("^[A-Z]{3}\\z"), before).otherwise("")


def price_parts(detail: Column) -> Column:
    """array<struct<currency, amount, basis>> of "EUR 9.24/case · EUR 0.77/unit": in each part
    a slash, the number before it, three capitals before that, and what the price is for."""

    def part(x: Column) -> Column:
        at = lambda k: F.get(x, (F.array_position(x, "/") - 1 + k).cast("int"))
        sign, basis = at(-2), F.lower(at(1))
        return F.struct(
            F.when(sign.rlike("^[A-Z]{3}\\z"), sign).otherwise("").alias("currency"),
            F.when(F.array_contains(x, "/"), _number(at(-1))).alias("amount"),
            F.when(basis.isin(BASES), basis).otherwise("").alias("basis"),
        )

    parts = F.transform(F.split(F.coalesce(detail, F.lit("")), "·"), _lexemes)
    return F.filter(F.transform(parts, part), lambda p: p["amount"].isNotNull())


def pack_size(detail: Column, spec: Column) -> Column:
    """The count of "(6pk)" in the detail, or the number before the cross that leads the spec."""
    said = F.concat(F.lit(" "), F.array_join(F.transform(_lexemes(detail), F.lower), " "), F.lit(" "))
    marked = blank(F.regexp_extract(said, " [(] ([0-9]+) pk [)] ", 1)).try_cast("int")
    lead = _lexemes(spec)
    crossed = F.lower(F.get(lead, F.lit(1))).rlike("^[x×]")
    return F.coalesce(marked, F.when(crossed, F.get(lead, F.lit(0)).try_cast("int")))


def count_or_null(x: Column) -> Column:
    return F.when(x > 0, half_up(x).cast("long"))


def volume_ml(text: Column) -> Column:
    """The first volume of a text in millilitres; weights and zeros do not count."""
    unit = "millilit(?:re|er)s?|centilit(?:re|er)s?|lit(?:re|er)s?|ltrs?|ml|cl|l"
    every = "(?i)[0-9]+(?:[.,][0-9]+)?\\s*(?:" + unit + ")(?![A-Za-z0-9_])"

    def to_ml(m: Column) -> Column:
        n = F.replace(F.regexp_extract(m, "^[0-9]+(?:[.,][0-9]+)?", 0), F.lit(","), F.lit(".")).cast("double")
        kind = F.lower(F.regexp_extract(m, "[A-Za-z]+\\z", 0))
        factor = F.when(kind.rlike("^(ml|millilit)"), 1).when(kind.rlike("^(cl|centilit)"), 10).otherwise(1000)
        return half_up(n * factor).cast("int")

    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(every), F.lit(0)), to_ml)
    return F.get(F.filter(found, lambda v: v > 0), F.lit(0))


def volume_label(ml: Column) -> Column:
    """440ml, 1L or 1.5L."""
    litres = F.concat(trimmed_number(ml / 1000), F.lit("L"))
    return F.when(ml.isNull() | (ml <= 0), F.lit("")).when((ml >= 1000) & (ml % 100 == 0), litres).otherwise(F.concat(half_up(ml).cast("string"), F.lit("ml")))


def volume_text(ml: Column) -> Column:
    """1.75L, 70cl or 333ml: litres from one on, centilitres where they come out even."""
    litres = F.concat(trimmed_number(ml / 1000), F.lit("L"))
    small = F.when(ml % 10 == 0, F.concat((ml / 10).cast("long").cast("string"), F.lit("cl"))).otherwise(F.concat(ml.cast("string"), F.lit("ml")))
    return F.when(ml.isNull() | (ml <= 0), F.lit("")).when(ml >= 1000, litres).otherwise(small)


def price_unit(basis: Column) -> Column:
    """Whether a price is by the case or by the unit, null where its basis does not say."""
    text = F.lower(F.coalesce(basis, F.lit("")))
    return F.when(text.rlike("case|pack"), "case").when(text.rlike("unit|bottle|btl|can|piece|jar"), "unit")


def basis_noun(basis: Column) -> Column:
    text = F.lower(F.coalesce(basis, F.lit("")))
    return (
        F.when(text.isin("case", "pack"), text)
        .when(text.isin("bottle", "btl"), F.lit("bottle"))
        .when(text.isin("piece", "jar", "can", "unit"), text)
        .otherwise(F.lit(""))
    )


def clean_name(name: Column) -> Column:
    """Without a price label, colons and punctuation at the end."""
    out = F.coalesce(name, F.lit(""))
    for _ in range(2):  # a label, and what stood before it
        bare = F.regexp_replace(out, "[\\s,;:]++\\z", "")
        colon = F.contains(F.substr(out, F.length(bare) + 1), F.lit(":"))
        last = F.regexp_extract(bare, "[A-Za-z0-9_]*+\\z", 0)
        out = F.when(colon & F.lower(last).isin(PRICE_LABELS), F.left(bare, F.length(bare) - F.length(last))).otherwise(bare)
    return F.trim(F.regexp_replace(out, "[\\s,;]++\\z", ""))


def variants(name: Column) -> Column:
    """struct<name, variants>: a tail after a dash with two commas or more is a list."""
    clean = clean_name(name)
    head, tail = (F.trim(F.regexp_extract(clean, "^(.+?)\\s+[—–-]\\s+(.*)\\z", k)) for k in (1, 2))
    split = (F.regexp_count(tail, F.lit(",")) >= 2) & (F.length(head) >= 8)
    return F.when(split, F.struct(head.alias("name"), tail.alias("variants"))).otherwise(F.struct(clean.alias("name"), F.lit("").alias("variants")))


def terms(text: Column) -> Column:
    """struct<incoterm, warehouse> of a text such as "EXW North Depot"."""
    t = F.trim(F.coalesce(text, F.lit("")))
    code = F.regexp_extract(t, "^([A-Z]{3})(?![A-Za-z0-9_])", 1)
    known = code.isin(INCOTERMS)
    return F.struct(F.when(known, code).otherwise(F.lit("")).alias("incoterm"), F.when(known, F.trim(F.substr(t, F.lit(4)))).otherwise(t).alias("warehouse"))


def unit_type(text: Column) -> Column:
    """The first of five kinds of unit that the text names."""
    said = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    kinds = [F.when(F.arrays_overlap(said, F.array(*map(F.lit, words.split()))), F.lit(kind)) for kind, words in UNIT_KINDS.items()]
    return F.coalesce(*kinds, F.lit(""))


def is_estimated(source: Column) -> Column:
    return F.trim(F.coalesce(source, F.lit(""))).isin("Supplier Default", "Category Rule")


def moq_label(kind: Column, qty: Column, currency: Column, legacy: Column) -> Column:
    """The minimum order as a buyer would say it; structured fields before free text."""
    n = F.when(qty > 0, qty)
    number = F.regexp_replace(F.format_number(n, 3), "\\.?0+\\z", "")
    out = F.when(kind == "No Minimum", F.lit("No minimum")).when((kind == "Order Value") & n.isNotNull() & (currency != ""), F.concat_ws(" ", currency, number))
    for name, (one, many) in UNIT_WORDS.items():
        out = out.when((kind == name) & n.isNotNull(), F.concat_ws(" ", number, F.when(n == 1, F.lit(one)).otherwise(F.lit(many))))
        if name in ("Container", "Full Truckload"):
            out = out.when(kind == name, F.lit(one.capitalize()))
    return out.when(F.trim(legacy) != "", F.trim(legacy)).when(kind != "", F.lit("On request")).otherwise(F.lit(""))


def moq_bucket(kind: Column) -> Column:
    return (
        F.when(kind == "", F.lit(""))
        .when(kind == "No Minimum", F.lit("No minimum"))
        .when(kind == "Order Value", F.lit("Minimum order value"))
        .when(kind.isin("Container", "Full Truckload"), F.lit("Full load only"))
        .when(kind == "Pallets", F.lit("Pallet minimum"))
        .when(kind == "Applies — Unspecified", F.lit(""))
        .otherwise(F.lit("Unit minimum"))
    )


def lead_label(days: Column) -> Column:
    """Zero is ex-stock; weeks only where exact."""
    weeks = (days / 7).cast("int")
    return (
        F.when(days.isNull() | (days < 0), F.lit(""))
        .when(days == 0, F.lit("Ex-stock"))
        .when(days == 1, F.lit("1 day"))
        .when(days == 7, F.lit("1 week"))
        .when(days % 7 == 0, F.concat(weeks.cast("string"), F.lit(" weeks")))
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def lead_bucket(days: Column) -> Column:
    return F.when(days.isNull() | (days < 0), F.lit("")).when(days == 0, F.lit("Ex-stock")).when(days <= 7, F.lit("Within a week")).when(days <= 28, F.lit("1–4 weeks")).otherwise(F.lit("Over 4 weeks"))


def duty_class(tier: Column) -> Column:
    text = F.lower(F.coalesce(tier, F.lit("")))
    return F.when(text.rlike("(?<![a-z0-9_])t1(?![a-z0-9_])|bond"), F.lit("bond")).when(text.rlike("(?<![a-z0-9_])t2(?![a-z0-9_])|duty\\s*-?\\s*paid|(?<![a-z0-9_])dp(?![a-z0-9_])"), F.lit("paid")).otherwise(F.lit(""))


def list_join(items: Column) -> Column:
    """"a, b and c"."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def to_days(n: Column, unit: Column, working: Column) -> Column:
    """Working days, weeks, months and hours as whole days."""
    u = F.lower(unit)
    return (
        F.when(u.startswith("week"), n * 7)
        .when(u.startswith("month"), n * 30)
        .when(u.startswith("hour"), F.ceil(n / 24))
        .when(working, F.ceil(n * 7 / 5))
        .otherwise(n)
        .cast("long")
    )


def terms_amount(text: Column) -> Column:
    """35k, 1.5m, 35.000 and 35,000.50: the last separator with three digits is thousands."""
    t = F.lower(F.regexp_replace(text, "(?<=[0-9])\\s(?=[0-9]{3}(?![0-9]))", ","))
    digits = F.regexp_extract(t, "[0-9][0-9.,]*", 0)
    plain = F.when(digits.rlike("[.,][0-9]{3}\\z"), F.regexp_replace(digits, "[.,]", "")).otherwise(
        F.regexp_replace(F.regexp_replace(digits, "[.,](?=.*[.,])", ""), ",", ".")
    )
    scale = F.when(t.rlike("[0-9]\\s*k(?![a-z])"), 1000).when(t.rlike("[0-9]\\s*m(?![a-z])"), 1000000).otherwise(1)
    return plain.try_cast("double") * scale


def price_label(amount: Column, currency: Column, basis: Column, short: bool = False) -> Column:
    """"EUR 9.24 per case", with a slash if short; without both parts a price on enquiry."""
    noun, per = basis_noun(basis), F.lit(" / " if short else " per ")
    money = F.concat(currency, F.lit(" "), F.format_string("%.2f", amount))
    priced = amount.isNotNull() & (F.coalesce(currency, F.lit("")) != "")
    return F.when(~priced, F.lit("price on enquiry")).when(noun == "", money).otherwise(F.concat(money, per, noun))


def pallet_label(cases: Column, pieces: Column) -> Column:
    each = [F.when(n > 0, F.concat(F.format_number(n, 0), F.lit(f" {word}/pallet"))) for n, word in ((cases, "cases"), (pieces, "pcs"))]
    return F.coalesce(*each, F.lit(""))


def listing_terms(moq: Column, estimated: Column, lead: Column, pallet: Column) -> Column:
    """Minimum order, lead time and pallet of a card; texts that say what they are stay bare."""
    said = moq.rlike(r"(?i)\b(?:moq|mov|minimum)\b|^min\b") & ~estimated
    first = F.when(said, moq).otherwise(F.concat(F.when(estimated, "MOQ typically ").otherwise("MOQ "), moq))
    second = F.when(lead.rlike(r"(?i)\blead\s*time\b"), lead).otherwise(F.concat(F.lit("Lead "), lead))
    parts = F.array(F.when(moq != "", first), F.when(lead != "", second), blank(pallet))
    return F.array_join(F.array_compact(parts), " · ")


def stock_phrase(delisted: Column, code: Column, qty: Column) -> Column:
    in_stock = F.when(qty > 0, F.concat(F.format_number(qty, 0), F.lit(" cases in stock"))).otherwise("in stock")
    return F.when(delisted, "sold out — request a quote").when(code == "in", in_stock).when(code == "warn", "limited availability").otherwise("enquire for availability")


def title_name(name: Column, tail: Column, whole: int = 110, least: int = 24) -> Column:
    """The name, cut with an ellipsis where name and tail would not fit a title."""
    budget = F.greatest(F.lit(least), whole - F.length(tail))
    cut = F.regexp_replace(F.left(name, budget - 1), "[\\s,;·—-]+\\z", "")
    return F.when(F.length(name) > budget, F.concat(cut, F.lit("…"))).otherwise(name)


def record_id(text: Column) -> Column:
    """The text if it is a record's id, else empty."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed.rlike("^rec[A-Za-z0-9]{14}\\z"), trimmed).otherwise("")


def place_alias(place: Column, aliases: dict[str, str]) -> Column:
    """The name that stands for a place, whatever its case, spaces and marks; else the place."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    out = place
    for name, stands in aliases.items():
        out = F.when(key(place) == key(F.lit(name)), stands).otherwise(out)
    return out


def tab_url(origin: str, tab: Column, tabs: list[str]) -> Column:
    """A page's tab, or the page where there is no such tab."""
    named = F.lower(F.regexp_replace(F.coalesce(tab, F.lit("")), "^#", ""))
    return F.when(named.isin(tabs), F.concat(F.lit(f"{origin}/#"), named)).otherwise(origin)


def enquiry_url(origin: str, name: Column, spec: Column, amount: Column, currency: Column, sold_out: Column) -> Column:
    """A link that opens a chat with a question about an offer; a sold-out price is not told."""
    detail = F.when(F.coalesce(spec, F.lit("")) != "", F.concat(F.lit(" ("), spec, F.lit(")"))).otherwise("")
    price = F.when(amount.isNotNull() & (currency != ""), F.concat(F.lit(" listed at "), currency, F.lit(" "), F.format_string("%.2f", amount))).otherwise("")
    ask = F.concat(F.lit("Hi, I'd like a quote for "), name, detail, price, F.lit("."))
    like = F.concat(F.lit("Hi, I'm looking for "), name, detail, F.lit(" — is this or a similar line available?"))
    coded = F.replace(F.url_encode(F.when(sold_out, like).otherwise(ask)), F.lit("+"), F.lit("%20"))
    for code, mark in (("%27", "'"), ("%28", "("), ("%29", ")"), ("%21", "!"), ("%7E", "~")):  # marks that stay in a link
        coded = F.replace(coded, F.lit(code), F.lit(mark))
    return F.concat(F.lit(f"{origin}?text="), coded)


def description(parts: list[Column], longest: int = 300) -> Column:
    """What a search result says of a page: the parts that are there, cut to length."""
    return F.left(F.array_join(F.array_compact(F.array(*(blank(p) for p in parts))), " · "), F.lit(longest))


def publicly_listed(status: Column, expired: Column, approval: Column, price_ok: Column, listing_ok: Column) -> Column:
    """Yes for a row that is out, not expired, approved and passed both checks; unknowns are No."""
    yes = status.isin("Live", "Broadcasted", "Sent") & ~F.coalesce(expired, F.lit(False)) & (approval == "Approved") & price_ok & listing_ok
    return F.when(yes, "Yes").otherwise("No")


def product_data(origin: str, valid_until: Column) -> Column:
    """A page's product as JSON-LD, from columns name, slug, spec, tier, price_detail, brand,
    category, amount, currency, price_basis, stock, qty, terms, origin and delisted. What a row
    does not say is left out; a sold-out price holds for no time."""
    said = lambda c: blank(F.trim(F.coalesce(c, F.lit(""))))
    kind = lambda name: F.lit(name).alias("@type")
    gone = F.col("delisted")
    stock = F.when(gone, "SoldOut").when(F.col("stock") == "in", "InStock").when(F.col("stock") == "warn", "LimitedAvailability")
    unit = price_unit(F.col("price_basis"))
    offer = F.struct(
        kind("Offer"), F.format_string("%.2f", "amount").alias("price"), F.col("currency").alias("priceCurrency"), F.concat(F.lit("https://schema.org/"), stock).alias("availability"),
        F.lit("https://schema.org/NewCondition").alias("itemCondition"), F.lit("http://purl.org/goodrelations/v1#Sell").alias("businessFunction"), F.lit("http://purl.org/goodrelations/v1#Business").alias("eligibleCustomerType"),
        F.when(unit.isNotNull(), F.struct(kind("QuantitativeValue"), unit.alias("unitText"), F.lit(1).alias("minValue"))).alias("eligibleQuantity"),
        F.struct(F.lit(f"{origin}/#org").alias("@id")).alias("seller"), F.when(~gone, F.date_format(valid_until, "yyyy-MM-dd")).alias("priceValidUntil"),
    )
    more = {"Pack size": said(F.col("spec")), "Duty status": said(F.col("tier")), "Incoterm": said(F.col("terms")), "Stock": F.when((F.col("qty") > 0) & ~gone, F.concat(F.format_number("qty", 0), F.lit(" cases"))), "Origin": said(F.col("origin"))}
    properties = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(kind("PropertyValue"), F.lit(k).alias("name"), v.alias("value"))) for k, v in more.items())))
    told = F.concat(F.concat_ws(" ", "name", "spec"), F.lit(", "), F.coalesce(said(F.col("tier")), F.lit("wholesale")), F.lit(". "), F.coalesce("price_detail", F.lit("")))
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), kind("Product"), F.col("name"), F.concat(F.lit(f"{origin}/offers/"), F.col("slug"), F.lit("/")).alias("url"), F.trim(told).alias("description"),
        F.when(said(F.col("brand")).isNotNull(), F.struct(kind("Brand"), F.col("brand").alias("name"))).alias("brand"), said(F.col("category")).alias("category"),
        F.when((F.col("amount") != 0) & said(F.col("currency")).isNotNull(), offer).alias("offers"), F.when(F.size(properties) > 0, properties).alias("additionalProperty"),
    ))
