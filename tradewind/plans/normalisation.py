"""Raw offers as offers, and their facets."""

from __future__ import annotations

from tradewind.operators.normalisation import normalised, with_facets
from tradewind.plans.registry import query

_OFFERS = r"""
d AS (SELECT * REPLACE (coalesce(nullif(price_detail, ''), price_display, '') AS price_detail),
             trim(regexp_replace(coalesce(description, ''), ' Price:$', '')) AS clean, trim(coalesce(variant, '')) AS own,
             TRY_CAST(replace(regexp_extract(price_display, '[0-9][0-9.,]*'), ',', '') AS DOUBLE) AS shown FROM raw_offers),
e AS (SELECT *, list_filter(list_transform(string_split(price_detail, '·'), lambda x: {
             'c': regexp_extract(x, '([A-Z]{3}) [0-9.,]+ ?/', 1), 'a': TRY_CAST(replace(regexp_extract(x, '([0-9.,]+) ?/', 1), ',', '') AS DOUBLE),
             'b': lower(regexp_extract(x, '(?i)/ ?(case|unit|btl|bottle|pack|can|jar|piece)', 1))}), lambda p: p.a IS NOT NULL) AS parts,
             trim(regexp_extract(clean, '^(.+?) +[—-] +(.*)$', 1)) AS h, trim(regexp_extract(clean, '^(.+?) +[—-] +(.*)$', 2)) AS t,
             coalesce(TRY_CAST(regexp_extract(price_detail, '\(([0-9]+)pk\)', 1) AS INT), TRY_CAST(regexp_extract(spec, '^([0-9]+) x', 1) AS INT)) AS told FROM d),
f AS (SELECT *, own = '' AND length(h) >= 8 AND length(t) - length(replace(t, ',', '')) >= 2 AS listed, parts[1] AS head,
             list_filter(parts, lambda p: p.b IN ('unit', 'btl', 'bottle', 'can', 'piece', 'jar'))[1] AS per, coalesce(told, CASE WHEN pcs_case > 1 THEN pcs_case END) AS n FROM e),
normal AS (SELECT id, ord, CASE WHEN listed THEN h ELSE clean END AS name, CASE WHEN listed THEN t ELSE own END AS variants,
  CASE WHEN lower(trim(coalesce(brand, ''))) = 'two' THEN '' ELSE trim(coalesce(brand, '')) END AS brand, coalesce(nullif(category, ''), 'Other') AS category,
  coalesce(nullif(currency, ''), nullif(head.c, ''), regexp_extract(price_display, '([A-Z]{3}) [0-9]', 1), '') AS currency, coalesce(head.a, shown) AS amount,
  CASE WHEN per IS NOT NULL THEN per.a WHEN head.b IN ('case', 'pack') THEN coalesce(floor(head.a / n * 10000 + 0.5) / 10000, head.a) ELSE coalesce(head.a, shown) END AS unit_amount,
  price_detail, CASE WHEN len(parts) > 0 THEN head.b ELSE lower(regexp_replace(coalesce(price_type, ''), '^Per ', '')) END AS price_basis,
  CASE WHEN stock_display ILIKE '%in stock%' THEN 'in' WHEN stock_display ILIKE '%limited%' THEN 'warn' ELSE 'enq' END AS stock, CAST(floor(stock_cases + 0.5) AS BIGINT) AS qty,
  coalesce(featured, false) AS featured, coalesce(mixed_load, false) AS mixed_load, volume_ml, pcs_case AS pack,
  CASE WHEN pallet_cases > 0 THEN CAST(floor(pallet_cases + 0.5) AS BIGINT) END AS pallet_cases, CASE WHEN pallet_pieces > 0 THEN CAST(floor(pallet_pieces + 0.5) AS BIGINT) END AS pallet_pieces,
  coalesce(spec, '') AS spec, coalesce(terms, '') AS terms, coalesce(tier, '') AS tier, coalesce(origin, '') AS origin, coalesce(unit_type, '') AS unit_type, coalesce(ean, '') AS ean,
  coalesce(ean_case, '') AS ean_case, coalesce(moq, '') AS moq, coalesce(lead_time, '') AS lead_time, coalesce(moq_type, '') AS moq_type, coalesce(moq_currency, '') AS moq_currency,
  coalesce(moq_source, '') AS moq_source, coalesce(bbd, '') AS bbd, coalesce(note, '') AS note, coalesce(offer_date, '') AS offer_date, coalesce(expiry_date, '') AS expiry_date,
  coalesce(nullif(warehouse, 'Other'), '') AS warehouse, coalesce(nullif(incoterm, 'Other'), '') AS incoterm, moq_qty, lead_time_days, told FROM f)"""


@query("p1_p6_offer_normalisation", f"WITH {_OFFERS} SELECT * EXCLUDE (told) FROM normal", "raw_offers")
def offer_normalisation(raw):
    return normalised(raw)


@query(
    "p6_p7_offer_facets",
    rf"""WITH {_OFFERS} SELECT ord, coalesce(CAST(CASE WHEN volume_ml > 0 THEN volume_ml END AS INT),
           CAST(TRY_CAST(regexp_extract(spec, '([0-9]+)(ml|cl)', 1) AS INT) * CASE WHEN spec LIKE '%cl%' THEN 10 ELSE 1 END AS INT)) AS volume_ml,
         coalesce(CASE WHEN pack > 0 THEN pack END, told) AS pack,
         CASE WHEN unit_type <> '' THEN unit_type WHEN regexp_matches(lower(spec || ' ' || name), '\bcan\b') THEN 'Can' WHEN spec LIKE '%bottle%' THEN 'Bottle' WHEN spec LIKE '%jar%' THEN 'Jar' ELSE '' END AS unit_type,
         CASE WHEN incoterm <> '' THEN incoterm WHEN regexp_matches(terms, '^(EXW|DAP)( |$)') THEN left(terms, 3) ELSE '' END AS incoterm,
         CASE WHEN warehouse <> '' THEN warehouse ELSE trim(regexp_replace(terms, '^(EXW|DAP)( |$)', '')) END AS warehouse FROM normal""",
    "raw_offers",
)
def offer_facets(raw):
    return with_facets(normalised(raw)).select("ord", "volume_ml", "pack", "unit_type", "incoterm", "warehouse")
