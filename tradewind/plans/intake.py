"""Lines and names of a buyer's enquiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import intake
from tradewind.operators import intake_payload as ip
from tradewind.plans.registry import query


@query(
    "f42_f43_f44_f45_wanted_line",
    r"""WITH w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(text, '[(),;|]', ' ', 'g'), '\s+'), lambda x: x <> '') AS words FROM enquiry_lines),
         b AS (SELECT *, array_to_string(words[1:least(4, coalesce(nullif(list_position(list_transform(words, lambda x: regexp_matches(x, '[0-9]') OR lower(x) IN ('x', 'case', 'cases', 'btl', 'bottle', 'bottles', 'pack', 'pk', 'ctn', 'carton')), true), 0) - 1, 4))], ' ') AS brand FROM w)
       SELECT line_id, brand, regexp_replace(trim(substr(text, length(brand) + 1)), '^[,:–-]+\s*', '') AS variant,
         CASE WHEN regexp_matches(text, '\bvodka\b', 'i') THEN 'Spirits' WHEN regexp_matches(text, '\brose\b', 'i') THEN 'Wine' WHEN regexp_matches(text, '\b(water|energy drink)\b', 'i') THEN 'Soft Drinks' WHEN regexp_matches(text, '\bshower gel\b', 'i') THEN 'Toiletries' ELSE '' END AS category,
         CASE WHEN regexp_matches(text, '\bpallets?\b', 'i') THEN 'Pallets' WHEN regexp_matches(text, '\b(cases?|ctns?)\b', 'i') THEN 'Cases' WHEN regexp_matches(text, '\bpcs\b', 'i') THEN 'Pieces' ELSE '' END AS unit,
         CASE WHEN regexp_matches(text, '\bt1\b', 'i') THEN 'T1' WHEN regexp_matches(text, 'under bond', 'i') THEN 'Bonded' WHEN regexp_matches(text, 'duty-?paid', 'i') THEN 'Duty Paid' ELSE '' END AS bond,
         CASE WHEN text ILIKE '%usd%' THEN 'USD' WHEN text LIKE '%€%' THEN 'EUR' WHEN text LIKE '%£%' THEN 'GBP' WHEN upper(currency) IN ('EUR', 'AED') THEN upper(currency) WHEN coalesce(currency, '') <> '' THEN 'Other' ELSE '' END AS currency,
         CASE WHEN TRY_CAST(regexp_replace(qty, '[^0-9.-]', '', 'g') AS DOUBLE) > 0 THEN TRY_CAST(regexp_replace(qty, '[^0-9.-]', '', 'g') AS DOUBLE) END AS qty FROM b""",
    "enquiry_lines",
)
def wanted_line(lines):
    text = F.col("text")
    return lines.withColumn("brand", intake.brand_of(text)).select(
        "line_id",
        "brand",
        intake.variant_of(text, F.col("brand")).alias("variant"),
        intake.first_kind(text, intake.CATEGORIES).alias("category"),
        intake.first_kind(text, intake.UNITS).alias("unit"),
        intake.first_kind(text, intake.BONDS).alias("bond"),
        intake.currency_of(text, F.col("currency")).alias("currency"),
        intake.positive_number(F.col("qty")).alias("qty"),
    )


@query(
    "f34_f46_f47_names",
    """SELECT contact_id, CASE WHEN contact_id % 4 = 0 THEN name WHEN contact_id % 4 = 1 THEN name || ', ' || segment WHEN contact_id % 4 = 2 AND country <> '' THEN country ELSE '' END AS client,
         CASE WHEN upper(country) = 'UNITED STATES' THEN 'unitedstates' WHEN contact_id % 3 = 0 THEN 'unitedkingdom' ELSE regexp_replace(lower(country), '[^a-z]', '', 'g') END AS country,
         CASE contact_id % 5 WHEN 0 THEN 'EUR 5,000 minimum order' WHEN 1 THEN 'Full truck load (FTL)' WHEN 2 THEN 'EUR 10,000 minimum order' END AS minimum FROM contacts""",
    "contacts",
)
def names(contacts):
    n = F.col("contact_id")
    record = F.concat(F.lit("rec"), F.lpad(n.cast("string"), 14, "0"))
    cached = F.when(n % 4 == 0, F.concat(F.lit(" "), "name")).when(n % 4 == 1, "")
    links = F.when(n % 4 == 1, F.array(record, "name", F.lit(" "), "segment")).otherwise(F.array(record))
    notes = F.when(n % 4 == 2, F.concat(F.lit("seen\nBuyer: "), "country", F.lit("\nlate"))).when(n % 4 == 3, "Buyer: Unattributed")
    country = F.when((n % 3 == 0) & (F.upper("country") != "UNITED STATES"), "Great Britain").otherwise(F.col("country"))
    category = F.when(n % 5 == 0, " Spirits").when(n % 5 == 1, "Beer").when(n % 5 == 2, "Other FMCG").when(n % 5 == 3, "Other")
    return contacts.select("contact_id", intake.client_name(cached, links, notes).alias("client"), intake.country_key(country).alias("country"), intake.house_minimum(category).alias("minimum"))


#: The service's answer unwrapped, its rows, and the lines made of them, in SQL of JSON paths.
_SERVICE = """
result AS (SELECT result_id, contact, CASE WHEN json_type(result, '$.fields') = 'OBJECT' THEN json_extract(result, '$.fields') ELSE result::JSON END AS j FROM service_results),
row_list AS (SELECT result_id, contact, j, unnest(from_json(json_extract(j, '$.results'), '["JSON"]')) AS r, generate_subscripts(from_json(json_extract(j, '$.results'), '["JSON"]'), 1) AS n FROM result),
made AS (
    SELECT result_id, n, contact, coalesce(nullif(trim(r->>'$.description'), ''), '(unnamed line)') AS description, CAST(r->>'$.sourceRow' AS BIGINT) AS source_row,
        coalesce(try_cast(r->>'$.quantity' AS DOUBLE), try_cast(r->>'$.unitsOrdered' AS DOUBLE)) AS qty, nullif(trim(r->>'$.quantityBasis'), '') AS unit,
        json_type(r, '$.match') = 'OBJECT' AS has, concat_ws(' ', nullif(r->>'$.match.brand', ''), nullif(r->>'$.match.productName', '')) AS name, r->>'$.match.brand' AS brand, CAST(r->>'$.match.volumeMl' AS DOUBLE) AS volume_ml,
        (r->>'$.needsReview') = 'true' AS review, r->>'$.wholesalePrice' AS price, regexp_replace(r->>'$.wholesaleBasis', '^Per ', '') AS basis, CAST(r->>'$.customerPriceBase' AS DOUBLE) AS target, r->>'$.note' AS note
    FROM row_list
), line_rows AS (
    SELECT result_id, n, contact, description, source_row, qty, unit, CASE WHEN has THEN CASE WHEN name = '' THEN 'matched' ELSE name END END AS matched, CASE WHEN has THEN brand END AS brand, CASE WHEN has THEN volume_ml END AS volume_ml,
        CASE WHEN has AND review THEN true END AS needs_review, CASE WHEN has AND price IS NOT NULL THEN price || ' EUR' || CASE WHEN basis <> '' THEN '/' || basis ELSE '' END END AS price, target, note FROM made
)"""


@query(
    "x28_p13_p14_service_lines",
    f"""WITH {_SERVICE} SELECT result_id, CAST(n AS INT) AS n, description, source_row, qty, unit, matched, brand, volume_ml, needs_review, price, target, note,
        1 + (source_row IS NOT NULL)::INT + (qty IS NOT NULL)::INT + (unit IS NOT NULL)::INT + (matched IS NOT NULL)::INT + (brand IS NOT NULL)::INT + (volume_ml IS NOT NULL)::INT + (needs_review IS NOT NULL)::INT
        + (price IS NOT NULL)::INT + (target IS NOT NULL)::INT + (note IS NOT NULL)::INT AS n_keys FROM line_rows""",
    "service_results",
)
def service_lines(s):
    """The lines of each answer, and how many keys are left of each when the unknown ones go."""
    each = s.select("result_id", F.posexplode(ip.lines(ip.parsed(F.col("result")))).alias("at", "l"))
    keys = F.size(F.json_object_keys(F.to_json("l")))
    named = [F.col(f"l.{old}").alias(new) for old, new in (("description", "description"), ("sourceRow", "source_row"), ("qty", "qty"), ("unit", "unit"), ("matched", "matched"), ("brand", "brand"), ("volumeMl", "volume_ml"), ("needsReview", "needs_review"), ("price", "price"), ("target", "target"), ("note", "note"))]
    return each.select("result_id", (F.col("at") + 1).alias("n"), *named, keys.alias("n_keys"))


def _told(s):
    """Answers and contacts parsed, in columns of their own, since a payload asks them for many keys."""
    return s.select("result_id", ip.parsed(F.col("result")).alias("told"), F.try_parse_json("contact").alias("who"))


@query(
    "s19_x25_x31_enquiries",
    f"""WITH {_SERVICE}, who AS (SELECT DISTINCT result_id, lower(nullif(contact->>'$.email', '')) AS email, nullif(contact->>'$.company', '') AS company, nullif(contact->>'$.name', '') AS name FROM result)
       SELECT w.result_id, concat_ws(',', CASE WHEN email IS NOT NULL THEN 'email' END, CASE WHEN name IS NOT NULL THEN 'name' END, CASE WHEN company IS NOT NULL THEN 'company' END, 'fileName', 'fileType', CASE WHEN w.result_id % 8 <> 0 THEN 'file' END, 'lines', 'summary') AS keys,
        concat_ws('; ', CASE WHEN email = 'no address' THEN 'invalid email address' END, CASE WHEN w.result_id % 8 = 0 THEN 'no inquiry file received' END) AS error_text,
        coalesce(company, name, email, 'Unattributed upload') AS display_name, l.summary AS line_summary, CAST(l.n AS STRING) AS requested_qty
       FROM who w JOIN (SELECT result_id, count(*) AS n, string_agg('- ' || concat_ws(' | ', description, 'matched: ' || matched, 'qty: ' || printf('%.0f', qty), price), chr(10) ORDER BY n) AS summary FROM line_rows GROUP BY result_id) l ON l.result_id = w.result_id""",
    "service_results",
)
def enquiries(s):
    """Answers as payloads, and payloads as the intake reads them: checks, names, summaries."""
    file = F.when(F.col("result_id") % 8 != 0, F.lit('{"name":"list.xlsx","file":"QUJD"}')).otherwise(F.lit("{}"))
    sent = _told(s).select("result_id", ip.payload(F.col("told"), F.col("who"), F.try_parse_json(file)).alias("sent"))
    read = ip.composed(sent.withColumn("body", ip.parsed(F.col("sent"))).withColumn("received", F.lit("2024-01-30 10:00:00").cast("timestamp")))
    count = F.format_string("%.0f", F.col("requested_qty").cast("double"))
    return read.select("result_id", F.array_join(F.json_object_keys("sent"), ",").alias("keys"), "error_text", "display_name", "line_summary", count.alias("requested_qty"))


@query(
    "j14_x26_unmatched_lines",
    f"""WITH {_SERVICE} SELECT result_id, 'W-IQ-20240130-100000-' || CAST(row_number() OVER (PARTITION BY result_id ORDER BY n) AS STRING) AS wanted_id, description AS raw, target, 'buyer ' || CAST(result_id % 10 AS STRING) AS client FROM line_rows WHERE matched IS NULL""",
    "service_results",
)
def unmatched_lines(s):
    """What nothing could be sold for, one row each, with the enquiry's client attached."""
    sent = _told(s).select("result_id", ip.payload(F.col("told"), F.col("who"), F.try_parse_json(F.lit("{}"))).alias("sent"))
    read = sent.select("result_id", ip.parsed(F.col("sent")).alias("body"), F.lit("IQ-20240130-100000").alias("enquiry_id"), F.concat(F.lit("buyer "), F.col("result_id") % 10).alias("client"))
    return ip.unmatched(read).select("result_id", "wanted_id", "raw", "target", "client")
