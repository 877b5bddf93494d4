"""Views of the star-schema tables as catalogue data.

Each view is one SELECT that Spark and an ANSI oracle both run, so that a query and its
oracle start from the same rows. Table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # The catalogue: one row for each part, in catalogue order `ord`.
    "offers": """
        SELECT CAST(p_partkey AS STRING) AS id, p_partkey AS ord, p_name AS name,
               CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS brand,
               p_type AS category,
               CAST(6 * (1 + p_partkey % 4) AS STRING) || ' x ' || CAST(p_size * 10 AS STRING) || 'ml' AS spec,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 10 END AS volume_ml,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS amount,
               CASE p_partkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency,
               CASE p_partkey % 4 WHEN 0 THEN 'case' WHEN 1 THEN 'unit' WHEN 2 THEN 'bottle' ELSE 'pack' END AS price_basis,
               CASE p_partkey % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'warn' WHEN 2 THEN 'in' ELSE 'enq' END AS stock,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 500 AS BIGINT) END AS qty,
               CASE p_partkey % 5 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'Bonded' WHEN 3 THEN 'Duty Paid' ELSE '' END AS tier,
               CASE p_partkey % 4 WHEN 0 THEN 'North Depot' WHEN 1 THEN 'South Depot' WHEN 2 THEN 'Harbour' ELSE '' END AS warehouse,
               CASE p_partkey % 3 WHEN 0 THEN 'EXW' WHEN 1 THEN 'DAP' ELSE '' END AS incoterm,
               p_partkey % 17 = 0 AS featured, p_partkey % 10 = 9 AS delisted,
               CASE WHEN p_partkey % 8 = 0 THEN '' ELSE '2024-0' || CAST(1 + p_partkey % 9 AS STRING) || '-1' || CAST(p_partkey % 10 AS STRING) END AS offer_date,
               6 * (1 + p_partkey % 4) AS pack,
               CASE p_partkey % 6 WHEN 0 THEN 'No Minimum' WHEN 1 THEN 'Order Value' WHEN 2 THEN 'Pallets' WHEN 3 THEN 'Cases' WHEN 4 THEN 'Container' ELSE '' END AS moq_type,
               CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(1 + p_partkey % 5 AS DOUBLE) END AS moq_qty,
               CASE p_partkey % 3 WHEN 0 THEN 'Supplier Default' WHEN 1 THEN 'Category Rule' ELSE 'Line' END AS moq_source,
               CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey * 5 % 43 AS INT) END AS lead_time_days,
               CASE WHEN p_partkey % 2 = 0 THEN '0' || CAST(50000000 + p_partkey AS STRING) ELSE '' END AS ean,
               CASE WHEN p_partkey % 5 = 0 THEN CAST(70000000 + p_partkey AS STRING) ELSE '' END AS ean_case
        FROM {part}""",
    # Raw offers as suppliers' rows hold them, with a column that must not be read.
    "raw_offers": """
        SELECT CAST(p_partkey AS STRING) AS id, p_partkey AS ord,
               CASE p_partkey % 5 WHEN 0 THEN p_name || ' Price:' WHEN 1 THEN p_name || ' crate — red, green, blue' WHEN 2 THEN p_name || ' crate - red, green' WHEN 3 THEN p_name || ' can' END AS description,
               CASE WHEN p_partkey % 15 = 0 THEN ' mint ' END AS variant, CASE WHEN p_partkey % 7 = 0 THEN ' Two ' WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS brand,
               CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_type END AS category,
               CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '24 x ' || CAST(p_size AS STRING) || 'cl bottle' WHEN 2 THEN CAST(p_size AS STRING) || 'ml jar' ELSE 'loose' END AS spec,
               CASE p_partkey % 6 WHEN 0 THEN 'EUR ' || CAST(p_size AS STRING) || '.40/case (6pk) · EUR 0.77/unit' WHEN 1 THEN 'USD 1,2' || CAST(10 + p_size AS STRING) || '.5/case (12pk)'
                    WHEN 2 THEN '' WHEN 3 THEN 'GBP ' || CAST(p_size AS STRING) || '/Bottle' WHEN 4 THEN CAST(p_size AS STRING) || ' / pack' END AS price_detail,
               CASE p_partkey % 7 WHEN 0 THEN 'EUR ' || CAST(p_size AS STRING) || '.05' WHEN 1 THEN '1,0' || CAST(10 + p_size AS STRING) || ' USD' WHEN 2 THEN 'on request' WHEN 3 THEN '' WHEN 4 THEN 'only PLN ' || CAST(p_size AS STRING) END AS price_display,
               CASE p_partkey % 3 WHEN 0 THEN 'Per Case' WHEN 1 THEN 'unit' END AS price_type, CASE p_partkey % 4 WHEN 0 THEN 'CHF' WHEN 1 THEN '' END AS currency,
               CASE p_partkey % 4 WHEN 0 THEN 'In Stock now' WHEN 1 THEN 'Limited' WHEN 2 THEN 'ask' END AS stock_display,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) + 0.5 END AS stock_cases,
               CASE p_partkey % 5 WHEN 0 THEN 'EXW Harbour' WHEN 1 THEN 'DAP' WHEN 2 THEN 'North Depot' WHEN 3 THEN 'EXWORKS' END AS terms,
               CASE p_partkey % 3 WHEN 0 THEN 'T1' WHEN 1 THEN '' END AS tier, CASE WHEN p_partkey % 2 = 0 THEN 'France' END AS origin,
               CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS featured, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size * 10 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) END AS volume_ml,
               CASE p_partkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS pcs_case,
               CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) - 20 END AS pallet_cases, CAST(p_size AS DOUBLE) * 2.5 AS pallet_pieces,
               CASE WHEN p_partkey % 10 = 0 THEN 'Tube' END AS unit_type, CASE WHEN p_partkey % 2 = 0 THEN CAST(50000000 + p_partkey AS STRING) END AS ean, CAST(NULL AS STRING) AS ean_case,
               CASE p_partkey % 4 WHEN 0 THEN 'Other' WHEN 1 THEN 'South Depot' WHEN 2 THEN '' END AS warehouse, CASE p_partkey % 4 WHEN 0 THEN 'FOB' WHEN 1 THEN 'Other' END AS incoterm,
               CASE WHEN p_partkey % 3 = 0 THEN '5 cases' END AS moq, CASE WHEN p_partkey % 4 = 0 THEN '2 weeks' END AS lead_time, CASE WHEN p_partkey % 5 = 0 THEN 'Cases' END AS moq_type,
               CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS DOUBLE) END AS moq_qty, CASE WHEN p_partkey % 6 = 0 THEN 'EUR' END AS moq_currency, CASE WHEN p_partkey % 7 = 0 THEN 'Line' END AS moq_source,
               p_partkey % 2 = 0 AS mixed_load, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 4 - 1 AS INT) END AS lead_time_days, CASE WHEN p_partkey % 9 = 0 THEN '2025-01' END AS bbd,
               CASE WHEN p_partkey % 8 = 0 THEN 'short date' END AS note, '2024-01-05' AS offer_date, CASE WHEN p_partkey % 2 = 0 THEN '2024-02-05' END AS expiry_date,
               p_retailprice AS supplier_cost
        FROM {part}""",
    # The catalogue with letters and marks that slugs and XML must mind.
    "site_offers": """
        SELECT ord, CASE WHEN ord % 5 = 1 THEN replace(name, 'e', 'é') ELSE name END AS name, CASE WHEN ord % 4 = 1 THEN replace(brand, 'Brand', 'Bránd') ELSE brand END AS brand,
               CASE category WHEN 'PROMO' THEN 'Promo & Gift' WHEN 'SMALL' THEN 'Spirits' WHEN 'LARGE' THEN 'Beer' ELSE category END AS category, spec, delisted, stock, qty, amount, currency, price_basis, tier,
               warehouse, incoterm, volume_ml, CASE WHEN ord % 3 = 0 THEN '' ELSE currency || ' ' || CAST(ord AS STRING) END AS price_detail, CASE WHEN ord % 2 = 0 THEN 'France' END AS origin
        FROM ({offers}) o""",
    # Two snapshots of the catalogue, as of yesterday and today.
    "offers_prev": "SELECT * FROM ({offers}) o WHERE ord % 10 <> 3",
    "offers_next": "SELECT id, ord, name, brand, category, spec, CASE WHEN ord % 20 = 1 THEN amount + 1 ELSE amount END AS amount, currency, stock, CASE WHEN ord % 15 = 2 THEN '' ELSE warehouse END AS warehouse FROM ({offers}) o WHERE ord % 10 <> 7",
    # What buyers asked for; today is 2024-01-30.
    "wanted": """
        SELECT event_id AS wanted_id, CAST(ts AS DATE) AS created, event_type AS brand,
               CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type || ' pack' END AS product,
               CAST(user_id % 3 AS INT) * 350 AS volume_ml, CASE user_id % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'Either' ELSE '' END AS bond,
               CASE user_id % 2 WHEN 0 THEN 'Spirits' ELSE 'Beer' END AS category,
               CASE WHEN event_id % 5 = 0 THEN '' ELSE 'client' || CAST(user_id AS STRING) END AS client,
               CAST(CAST(floor(value) AS BIGINT) AS DECIMAL(18, 4)) AS qty, CASE user_id % 3 WHEN 0 THEN 'Cases' WHEN 1 THEN 'Pallets' ELSE '' END AS unit,
               CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS BIGINT) ELSE 0 END AS target,
               CASE event_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE '' END AS currency,
               CASE WHEN value > 30 THEN 1 ELSE 0 END AS match_count,
               CASE event_id % 9 WHEN 0 THEN 'Offered' ELSE 'Open' END AS status,
               CASE event_id % 6 WHEN 0 THEN 'Instant Quote' ELSE 'Email' END AS source
        FROM {events}""",
    "contacts": """
        SELECT c_custkey AS contact_id, CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN CAST(c_custkey AS STRING) || '@g.us' ELSE CAST(c_custkey % 1100 AS STRING) || '@c.us' END AS chat,
               c_name AS name, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE n_name END AS country, c_mktsegment AS segment
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # Supplier messages of one to four lines, each put together from parts that vary apart from each other.
    "messages": """
        SELECT p_partkey AS message_id, concat_ws(chr(10),
            CASE WHEN p_partkey % 11 = 3 THEN 'Can you match this?' WHEN p_partkey % 4 = 0 THEN '*Stock offer* (Ex Loen | 6-7 weeks)' WHEN p_partkey % 4 = 1 THEN 'Good morning' END,
            CASE p_partkey % 13 WHEN 0 THEN '3 truckloads ' WHEN 1 THEN CAST(p_size AS STRING) || ' cs ' ELSE '' END || p_name
            || CASE p_partkey % 5 WHEN 0 THEN ' 6x70cl' WHEN 1 THEN ' 24 x 330ml' WHEN 2 THEN ' (12 × 35 CL)' WHEN 3 THEN ' ' || CAST(p_size AS STRING) || 'cl' ELSE '' END
            || CASE p_partkey % 7 WHEN 0 THEN ' – 1,250 cs' WHEN 1 THEN ' - 2 loads' WHEN 2 THEN ' - FTL' WHEN 3 THEN ' - EXW PLG - ' || CAST(p_size AS STRING) || ' btls available' ELSE '' END
            || CASE WHEN p_partkey % 23 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN ' @ EUR 5 - EUR 6' WHEN p_partkey % 17 = 0 THEN ' @ about EUR ' || CAST(p_size AS STRING)
                    WHEN p_partkey % 3 = 0 THEN ' @ EUR ' || CAST(1 + p_partkey % 97 AS STRING) || '.' || CAST(10 + p_partkey % 89 AS STRING)
                    WHEN p_partkey % 3 = 1 THEN ': ' || CAST(1 + p_partkey % 97 AS STRING) || ',' || CAST(10 + p_partkey % 89 AS STRING) || ' €/btl'
                    ELSE ' Price: ' || CAST(1 + p_partkey % 97 AS STRING) || ' dhs per case' END
            || CASE p_partkey % 6 WHEN 0 THEN ' | DAP Loen' WHEN 1 THEN ' EXW Riga' WHEN 2 THEN ' T1' WHEN 3 THEN ' | lead time 10 days' ELSE '' END,
            CASE p_partkey % 8 WHEN 0 THEN 'Nescafé gold 200g – 1,250 cs 7,50 € per pcs' WHEN 1 THEN p_brand || ' 33cl @ EUR 2.' || CAST(10 + p_size AS STRING) WHEN 2 THEN 'bbd 04/2028'
                WHEN 3 THEN 'price for all EUR 9.99' WHEN 4 THEN '48 cases per pallet' WHEN 5 THEN p_brand || ' loose - 2,400 btls @ EUR 163/btl' END,
            CASE p_partkey % 9 WHEN 0 THEN 'MOQ: 2 pallets. thanks' WHEN 1 THEN 'Lead time: 10 days' WHEN 2 THEN 'EAN: 5012345678900' WHEN 3 THEN 'EXW Poland or Riga'
                WHEN 4 THEN '24 pcs per case' WHEN 5 THEN 'bbd: 05/2027 - 04/2028' END) AS text,
            CASE WHEN p_partkey % 2 = 0 THEN 'FCA' END AS own_incoterm, CASE WHEN p_partkey % 3 = 0 THEN '14 days' ELSE '' END AS own_lead
        FROM {part}""",
    # Lines of buyers' enquiries, of seven shapes.
    "enquiry_lines": """
        SELECT p_partkey AS line_id, CASE p_partkey % 7
            WHEN 0 THEN 'North Star vodka 12 x 70cl, 5 cases T1'
            WHEN 1 THEN p_brand || ' (' || p_name || ') water; 3 pallets under bond'
            WHEN 2 THEN 'Case of shower gel duty-paid USD 4'
            WHEN 3 THEN 'Old Harbour Dry Rose wine ' || CAST(p_size AS STRING) || ' pcs €2'
            WHEN 4 THEN p_type || ' energy drink - ' || CAST(p_size AS STRING) || 'ml, 2 ctns'
            WHEN 5 THEN 'Bright Line: £1.20 ' || p_name ELSE '' END AS text,
            CASE p_partkey % 4 WHEN 0 THEN 'eur' WHEN 1 THEN 'PLN' WHEN 2 THEN '' END AS currency,
            CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) || ' cs' WHEN 1 THEN '-4' WHEN 2 THEN 'some' WHEN 3 THEN '1,250.5' END AS qty
        FROM {part}""",
    # Suppliers' lines with terms in any of five columns, and the supplier's defaults.
    "term_lines": """
        SELECT p_partkey AS line_id,
            p_name || CASE p_partkey % 6 WHEN 0 THEN ' 12x70cl MOQ ' || CAST(1 + p_size AS STRING) || ' cases' WHEN 1 THEN ' — Lead time 2 weeks' WHEN 2 THEN ' min = ' || CAST(3 * p_size AS STRING) || ' cases'
                WHEN 3 THEN ' MOQ 50 cases - lead time 3-' || CAST(4 + p_size AS STRING) || ' weeks' ELSE '' END AS name,
            CASE p_partkey % 11 WHEN 0 THEN CAST(10 + p_size AS STRING) || ' cases' WHEN 1 THEN 'USD 3' || CAST(p_size % 10 AS STRING) || ',000' WHEN 2 THEN 'MOQ: ' || CAST(p_size AS STRING) WHEN 3 THEN 'Minimum order 35.000 CHF'
                WHEN 4 THEN 'no minimum' WHEN 5 THEN 'ask' WHEN 6 THEN 'MOQ EUR 20,000 or 500 cases' WHEN 7 THEN ' ' END AS moq,
            CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS STRING) || ' days' WHEN 1 THEN '2-3 weeks' WHEN 2 THEN 'READY' WHEN 3 THEN 'tbc' WHEN 4 THEN '10 working days' WHEN 5 THEN '' END AS lead,
            CASE p_partkey % 5 WHEN 0 THEN 'can be mixed' WHEN 1 THEN 'min order 15k GBP per shipment' WHEN 2 THEN 'full pallets only; dispatch 48 hours' WHEN 3 THEN 'MOQ on request' END AS notes,
            CASE p_partkey % 4 WHEN 0 THEN 'Lead time 5 days' WHEN 1 THEN 'Minimum mixed order USD 25,000' ELSE '' END AS header,
            CASE p_partkey % 9 WHEN 0 THEN 'Cases' WHEN 1 THEN 'pallets' WHEN 2 THEN 'nonsense' END AS default_unit, CAST(p_partkey % 4 * 10 AS INT) AS default_qty, CASE WHEN p_partkey % 5 < 2 THEN 14 END AS default_days
        FROM {part}""",
    # What suppliers' systems send: numbers, dates and JSON as text, some of it broken.
    "raw_rows": """
        SELECT event_id AS row_id, CASE event_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END AS qty,
               CASE event_id % 5 WHEN 0 THEN '2024-02-31' WHEN 1 THEN 'soon' ELSE '2024-01-1' || CAST(event_id % 10 AS STRING) END AS offered,
               CASE event_id % 6 WHEN 0 THEN '"k": ' WHEN 1 THEN NULL ELSE props END AS props, event_type
        FROM {events}""",
    # What a pricing service answers, and what is posted to the intake: JSON, wrapped or bare.
    "service_results": """
        SELECT p_partkey AS result_id, CASE WHEN p_partkey % 3 = 0 THEN '{{"fields":' ELSE '' END || '{{"results":['
            || '{{"description":"' || p_name || '","sourceRow":' || CAST(p_partkey AS STRING) || ',"quantity":' || CASE p_partkey % 4 WHEN 0 THEN 'null,"unitsOrdered":"12"' WHEN 1 THEN '"many"' ELSE CAST(p_size AS STRING) END || ',"quantityBasis":"' || CASE WHEN p_partkey % 2 = 0 THEN 'Cases' ELSE ' ' END || '"'
            || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',"match":null' WHEN 2 THEN ',"match":{{}},"needsReview":true' ELSE ',"match":{{"brand":"' || p_brand || '","productName":"' || p_type || '","volumeMl":' || CAST(p_size * 10 AS STRING) || '}},"needsReview":false' END
            || ',"wholesalePrice":' || CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) ELSE CAST(p_size AS STRING) || '.5' END || ',"wholesaleCurrency":"EUR","wholesaleBasis":"' || CASE WHEN p_partkey % 4 = 3 THEN 'Per btl' ELSE '' END || '"'
            || CASE WHEN p_partkey % 7 = 0 THEN ',"customerPriceBase":"22.25"' ELSE '' END || '}}'
            || CASE WHEN p_partkey % 2 = 0 THEN ',{{"description":" ","note":"second"}}' ELSE '' END
            || '],"summary":{{"totalRows":' || CAST(1 + (p_partkey + 1) % 2 AS STRING) || ',"currency":"' || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'EUR' END || '"}}}}' || CASE WHEN p_partkey % 3 = 0 THEN '}}' ELSE '' END AS result,
            '{{"email":"' || CASE p_partkey % 5 WHEN 0 THEN 'Ann@Buy.example' WHEN 1 THEN 'no address' ELSE '' END || '","company":"' || CASE WHEN p_partkey % 3 = 1 THEN p_brand || ' Ltd' ELSE '' END || '","name":"' || CASE WHEN p_partkey % 4 = 1 THEN 'Ann' ELSE '' END || '"}}' AS contact
        FROM {part}""",
    # Parser results: one row for each order line.
    "parse_rows": """
        SELECT l_suppkey AS supplier, CASE WHEN l_returnflag = 'R' THEN 'Unrecognised' WHEN l_linestatus = 'O' THEN 'Partial' ELSE 'Clean' END AS status,
               CASE WHEN l_linenumber = 1 THEN '' ELSE 'Cases' END AS moq_type, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber - 1 END AS lead_days,
               CASE WHEN l_returnflag = 'R' THEN 'Unparsed: Part ' || CAST(l_partkey % 40 AS STRING) ELSE 'ok' END AS notes
        FROM {lineitem}""",
}

#: Views of texts whose reading costs far more than their bytes tell, with a key of each. Spark cuts
#: files by bytes, so that a few MB of rows would be read by a few tasks.
TEXTS = {"messages": "message_id", "enquiry_lines": "line_id", "term_lines": "line_id", "service_results": "result_id"}


def as_sql(name: str) -> str:
    """The view's SELECT over plain table names, for an oracle."""
    inner = {view: as_sql(view) for view in VIEWS if f"{{{view}}}" in VIEWS[name]}
    return VIEWS[name].format(**{t: t for t in TABLES}, **inner)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for inner in VIEWS:
        text = text.replace(f"{{{inner}}}", VIEWS[inner]) if f"{{{inner}}}" in text else text
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    rows = spark.sql(text, **used)
    return spread(rows, TEXTS[name]) if name in TEXTS else rows


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over all cores, in four tasks for each."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
