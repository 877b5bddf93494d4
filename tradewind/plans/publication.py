"""What is published: views from allow-lists, redirect lists, positional lists, key figures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradewind.operators import positions, public_view, publication, slugs
from tradewind.operators.public_view import Field
from tradewind.plans.catalogue import canonical_representative
from tradewind.plans.registry import query

_LISTED = "CASE WHEN b.stock_display IS NOT NULL AND coalesce(b.price_display, '') <> '' AND b.supplier_cost < 1500 THEN 'Yes' ELSE 'No' END"
PUBLIC = [
    Field("Record", "id"), Field("Description", "description"), Field("Variant", "variant"), Field("Brand", "brand"), Field("Category", "category"), Field("Spec", "spec"),
    Field("Price Display", "price_display"), Field("Currency", "currency"), Field("Terms", "terms"), Field("Tier", "tier"), Field("Featured", "featured"),
    Field("Volume", "volume_ml"), Field("MOQ Type", "moq_type"), Field("MOQ Source", "moq_source"), Field("note", "note"), Field("Public Listing", "public_listing", _LISTED),
    Field("Expired", "is_expired", "CASE WHEN b.expiry_date < '2024-02-01' THEN 'Yes' ELSE 'No' END", only_filter=True),
]


def _view(raw) -> tuple[str, str]:
    spark, mark = raw.sparkSession, uuid.uuid4().hex
    raw.createOrReplaceTempView(f"raw_{mark}")
    public_view.create(spark, f"public_{mark}", f"raw_{mark}", PUBLIC, "b.qty_known", temporary=True)
    return f"public_{mark}", f"raw_{mark}"


@query(
    "s11_p20_public_view",
    f"SELECT {', '.join(f'{f.computed or f.column} AS {f.column}' for f in PUBLIC)} FROM raw_offers b WHERE b.stock_cases IS NOT NULL",
    "raw_offers",
)
def public_rows(raw):
    """The generated view's rows: listed columns, two computed in place, no soft-deleted row."""
    view, _ = _view(raw.withColumn("qty_known", F.col("stock_cases").isNotNull()))
    return raw.sparkSession.table(view)


_COLUMNS = "id ord description variant brand category spec price_detail price_display price_type currency stock_display stock_cases terms tier origin featured volume_ml pcs_case pallet_cases pallet_pieces unit_type ean ean_case warehouse incoterm moq lead_time moq_type moq_qty moq_currency moq_source mixed_load lead_time_days bbd note offer_date expiry_date supplier_cost".split()


@query(
    "a23_s11_view_audit",
    " UNION ALL ".join(
        [f"SELECT 'view' AS object, '{f.column}' AS col, '{'filter' if f.only_filter else 'public'}' AS status, count({f.computed or f.column}) AS filled FROM raw_offers b WHERE stock_cases IS NOT NULL" for f in PUBLIC]
        + [f"SELECT 'base', '{c}', 'not listed', count({c}) FROM raw_offers" for c in [*_COLUMNS, "stock_cases IS NOT NULL"]]
    ).replace("'stock_cases IS NOT NULL'", "'qty_known'").replace("count(stock_cases IS NOT NULL)", "count(*)"),
    "raw_offers",
)
def view_audit(raw):
    """Columns as the catalog has them, with their status, and how many rows fill each."""
    wide = raw.withColumn("qty_known", F.col("stock_cases").isNotNull())
    view, base = _view(wide)
    spark = raw.sparkSession
    audited = public_view.audit(spark, {view: PUBLIC, base: None})
    filled = []
    for name, label in ((view, "view"), (base, "base")):
        table = spark.table(name)
        counts = table.agg(*(F.count(c).alias(c) for c in table.columns))
        filled.append(counts.unpivot([], table.columns, "col", "filled").withColumn("object", F.lit(label)).withColumn("_name", F.lit(name)))
    both = filled[0].unionByName(filled[1])
    return both.join(audited.select(F.col("object").alias("_name"), F.col("column").alias("col"), "status"), ["_name", "col"]).select("object", "col", "status", "filled")


_BASE = "CASE WHEN p_partkey % 9 = 0 THEN replace(p_name, ' ', '-') || '-' || CAST(2 + p_partkey % 3 AS STRING) ELSE replace(p_name, ' ', '-') END"


@query(
    "w1_ordered_slugs",
    f"""WITH RECURSIVE named AS (SELECT p_partkey AS ord, replace(p_name, ' ', '-') AS root, {_BASE} AS slug FROM part),
        placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ord) AS k FROM named),
        folded AS (
            SELECT root, k, ord, slug, slug AS unique_slug, [slug] AS taken FROM placed WHERE k = 1
            UNION ALL
            SELECT p.root, p.k, p.ord, p.slug, c.free, list_append(f.taken, c.free)
            FROM folded f JOIN placed p ON p.root = f.root AND p.k = f.k + 1,
                LATERAL (SELECT list_filter(list_prepend(p.slug, list_transform(range(2, len(f.taken) + 3), lambda n: p.slug || '-' || CAST(n AS STRING))), lambda s: NOT list_contains(f.taken, s))[1] AS free) c
        )
        SELECT ord, slug, unique_slug FROM folded""",
    "part",
)
def ordered_slugs(part):
    """The first free slug for each row, where natural slugs look like generated ones."""
    return slugs.deduped(part.select(F.col("p_partkey").alias("ord"), F.expr(_BASE).alias("slug")))


_SPELLED = "CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN ' ' || p_brand WHEN 2 THEN 'Moët ' || p_brand ELSE p_brand END"


@query(
    "d9_legacy_brand_slugs",
    f"""WITH RECURSIVE spelled AS (SELECT trim({_SPELLED}) AS brand FROM part), often AS (SELECT brand, count(*) AS n FROM spelled WHERE brand <> '' GROUP BY brand HAVING count(*) >= 2),
        based AS (SELECT *, regexp_replace(regexp_replace(lower(brand), '[^a-z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g') || '-wholesale' AS base FROM often),
        placed AS (SELECT *, row_number() OVER (ORDER BY lower(replace(brand, 'ë', 'e')), brand DESC) AS ord FROM based),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS k FROM placed)
        SELECT brand, CASE WHEN k = 1 THEN base ELSE base || '-' || CAST(k AS STRING) END AS slug FROM ranks""",
    "part",
)
def legacy_brand_slugs(part):
    """Old brand pages: one for each spelling, suffixes in the locale's alphabetical order."""
    return slugs.legacy_brand_slugs(part.select(F.expr(_SPELLED).alias("brand")))


@query(
    "j7_positional_zip",
    """WITH a AS (SELECT row_number() OVER (ORDER BY ord) AS position, id, name FROM offers_prev), b AS (SELECT row_number() OVER (ORDER BY ord) AS position, id, name FROM offers_next WHERE ord % 7 <> 0)
       SELECT coalesce(a.position, b.position) AS position, a.id AS from_id, b.id AS to_id, coalesce(a.name <> b.name, true) AS differs FROM a FULL JOIN b ON a.position = b.position""",
    "offers_prev",
    "offers_next",
)
def positional_zip(prev, nxt):
    """Two lists of unequal length, place by place."""
    both = positions.zipped(prev.select("id", "name", "ord"), nxt.where("ord % 7 <> 0").select("id", "name", "ord"), "ord", bits=6)
    return both.select("position", F.col("left.id").alias("from_id"), F.col("right.id").alias("to_id"), F.coalesce(F.col("left.name") != F.col("right.name"), F.lit(True)).alias("differs"))


@query(
    "j13_positional_results",
    """WITH sends AS (SELECT row_number() OVER (ORDER BY contact_id) AS position, contact_id, segment FROM contacts WHERE chat <> ''),
        results AS (SELECT row_number() OVER (ORDER BY event_id) AS position, event_type FROM events WHERE event_id % 3 <> 0)
       SELECT s.position, s.contact_id, s.segment, CASE WHEN r.event_type IS NULL THEN 'no result' WHEN r.event_type = 'error' THEN 'failed' ELSE 'sent' END AS outcome
       FROM sends s LEFT JOIN results r ON r.position = s.position""",
    "contacts",
    "events",
)
def positional_results(contacts, events):
    """Send i and result i; sends beyond the results have none, results beyond the sends are not asked for."""
    sends = contacts.where("chat <> ''").select(F.col("contact_id").alias("ord"), "segment")
    results = events.where("event_id % 3 <> 0").select(F.col("event_id").alias("ord"), "event_type")
    kind = F.col("right.event_type")
    outcome = F.when(kind.isNull(), "no result").when(kind == "error", "failed").otherwise("sent")
    both = positions.zipped(sends, results, "ord", bits=8).where("left IS NOT NULL")
    return both.select("position", F.col("left.ord").alias("contact_id"), F.col("left.segment").alias("segment"), outcome.alias("outcome"))


@query(
    "s10_d5_d6_published_state",
    """WITH rows AS (SELECT p_type AS scope, p_brand AS key, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'Over ' || CAST(p_size AS STRING) END AS value, p_partkey % 3 = 0 AS publish, p_partkey AS ord FROM part WHERE p_type <> 'PROMO'),
        now AS (SELECT scope, key, min_by(trim(value), ord) AS value FROM rows WHERE publish AND trim(value) <> '' GROUP BY scope, key),
        prev AS (SELECT p_type AS scope, p_brand AS key, 'Over ' || CAST(min(p_size) AS STRING) AS value, 1 AS version FROM part WHERE p_partkey % 2 = 0 AND p_size % 4 <> 0 AND p_size % 4 <> 1 GROUP BY p_type, p_brand),
        reads AS (SELECT p_type AS scope, p_type NOT IN ('LARGE', 'ECONOMY') AS ok, 2 AS version FROM part WHERE p_type <> 'SMALL' GROUP BY p_type)
       SELECT p.scope, p.key, p.value, p.version FROM prev p WHERE p.scope NOT IN (SELECT scope FROM reads WHERE ok)
       UNION ALL
       SELECT n.scope, n.key, n.value, CASE WHEN p.value = n.value THEN p.version ELSE r.version END FROM now n JOIN reads r ON r.scope = n.scope AND r.ok LEFT JOIN prev p ON p.scope = n.scope AND p.key = n.key""",
    "part",
)
def published_state(part):
    """Figures of each scope after a round: read now, withdrawn, or kept from the snapshot."""
    rows = part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("scope"), F.col("p_brand").alias("key"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'Over ' || CAST(p_size AS STRING) END").alias("value"), F.expr("p_partkey % 3 = 0").alias("publish"), F.col("p_partkey").alias("ord"))
    # The snapshot as a file has it: one JSON object for each scope, with odd values in it.
    value = F.expr("CASE p_size % 4 WHEN 0 THEN '\" \"' WHEN 1 THEN '7' ELSE '\"Over ' || CAST(p_size AS STRING) || '\"' END")
    first = part.where("p_partkey % 2 = 0 AND p_size % 4 <> 0 AND p_size % 4 <> 1").groupBy("p_type", "p_brand").agg(F.min(F.struct("p_size", value.alias("v")))["v"].alias("v"))
    odd = part.where("p_partkey % 2 = 0 AND p_size % 4 < 2").groupBy("p_type", "p_brand").agg(F.min(value).alias("v")).join(first.select("p_type", "p_brand"), ["p_type", "p_brand"], "left_anti")
    entries = F.concat(F.lit('"'), "p_brand", F.lit('":'), "v")
    files = first.unionByName(odd).groupBy("p_type").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entries), ","), F.lit("}")).alias("json"))
    previous = files.select(F.col("p_type").alias("scope"), F.explode(publication.from_snapshot(F.col("json"))).alias("key", "value"), F.lit(1).alias("version"))
    reads = part.where("p_type <> 'SMALL'").groupBy(F.col("p_type").alias("scope")).agg(F.lit(2).alias("version")).withColumn("ok", ~F.col("scope").isin("LARGE", "ECONOMY"))
    return publication.next_state(previous, publication.published(rows), reads)


@query(
    "p19_self_canonical_archive",
    """SELECT ord FROM (SELECT ord, delisted, first_value(ord) OVER (PARTITION BY name, spec ORDER BY delisted, CASE stock WHEN 'in' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, coalesce(qty, 0) DESC, amount ASC NULLS LAST, ord) AS canonical FROM offers)
       WHERE delisted AND canonical = ord""",
    "offers",
)
def self_canonical_archive(o):
    """Sold-out pages that stay in the site map: those that no live twin stands for."""
    return canonical_representative(o).join(o.where("delisted").select("ord"), "ord").where("canonical = ord").select("ord")
