"""Demand digest, parse digest and broadcast planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.functions.js import numbered, percent
from tradewind.plans.registry import query

#: The reporting week and the look-back before today, in days; today is 2024-01-30.
REPORT, BACK, TODAY = 7, 28, "2024-01-30"
#: Sends in one run, days in which an offer is not sent again, entries kept in its log.
SENDS, COOLDOWN, KEEP = 450, 45, 120


def groups(wanted):
    """Unmatched demand by product, size and bond: this week's counts, and repeats."""
    day = F.to_date(F.lit(TODAY))
    seen = wanted.where((F.col("created") >= F.date_sub(day, BACK)) & (F.col("match_count") == 0) & (F.col("status") != "Offered"))
    week = F.col("created") >= F.date_sub(day, REPORT)
    now = lambda x: F.when(week, x)
    return (
        seen.groupBy(F.lower("brand").alias("k"), "volume_ml", F.lower("bond").alias("bond"))
        .agg(
            F.count_if(week).alias("asks"),
            F.count_if(~week).alias("prior"),
            F.coalesce(F.sum(now(F.col("qty"))), F.lit(0)).cast("decimal(18,4)").alias("qty"),
            F.countDistinct(now(F.nullif("client", F.lit("")))).alias("buyers"),
            F.array_join(F.array_sort(F.collect_set(now(F.nullif("unit", F.lit(""))))), " / ").alias("units"),
            F.min("created").alias("first_asked"),
            F.max(now(F.col("created"))).alias("last_asked"),
        )
        .where("asks > 0")
    )


_SEEN = f"SELECT *, created >= DATE '{TODAY}' - {REPORT} AS week FROM wanted WHERE created >= DATE '{TODAY}' - {BACK} AND match_count = 0 AND status <> 'Offered'"
_GROUPS = f"""SELECT lower(brand) AS k, volume_ml, lower(bond) AS bond, count(*) FILTER (WHERE week) AS asks, count(*) FILTER (WHERE NOT week) AS prior,
    CAST(coalesce(sum(qty) FILTER (WHERE week), 0) AS DECIMAL(18, 4)) AS qty, count(DISTINCT nullif(client, '')) FILTER (WHERE week) AS buyers,
    coalesce(string_agg(DISTINCT nullif(unit, ''), ' / ' ORDER BY nullif(unit, '')) FILTER (WHERE week), '') AS units, min(created) AS first_asked, max(created) FILTER (WHERE week) AS last_asked
    FROM ({_SEEN}) GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE week) > 0"""


@query("a11_w4_w7_demand_groups", _GROUPS, "wanted")
def demand_groups(w):
    return groups(w)


@query("t9_x29_demand_ranking", f"SELECT k, volume_ml, bond, units, row_number() OVER (ORDER BY buyers DESC, asks DESC, qty DESC, k, volume_ml, bond) AS r FROM ({_GROUPS}) QUALIFY r <= 20", "wanted")
def demand_ranking(w):
    """The supplier-safe top of the brief: no buyer and no price."""
    order = [F.desc("buyers"), F.desc("asks"), F.desc("qty"), F.col("k"), F.col("volume_ml"), F.col("bond")]
    return groups(w).orderBy(*order).limit(20).withColumn("r", numbered(Window.orderBy(*order))).select("k", "volume_ml", "bond", "units", "r")


@query(
    "a12_target_ranges",
    f"""SELECT k, string_agg(part, ', ' ORDER BY part) AS targets FROM (SELECT lower(brand) AS k, cur || ' ' || CAST(min(target) AS STRING) || CASE WHEN min(target) = max(target) THEN '' ELSE '–' || CAST(max(target) AS STRING) END AS part
        FROM (SELECT *, CASE WHEN currency = '' THEN 'EUR' ELSE currency END AS cur FROM ({_SEEN})) WHERE week AND target > 0 GROUP BY lower(brand), cur) GROUP BY k""",
    "wanted",
)
def target_ranges(w):
    day = F.to_date(F.lit(TODAY))
    open_ = w.where((F.col("created") >= F.date_sub(day, REPORT)) & (F.col("match_count") == 0) & (F.col("status") != "Offered") & (F.col("target") > 0))
    currency = F.coalesce(F.nullif("currency", F.lit("")), F.lit("EUR"))
    each = open_.groupBy(F.lower("brand").alias("k"), currency.alias("cur")).agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    span = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("–", F.col("lo").cast("string"), F.col("hi").cast("string")))
    return each.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "cur", span))), ", ").alias("targets"))


@query(
    "a13_coverage",
    f"SELECT n AS rows, matched, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(100.0 * matched / n + 0.5) AS BIGINT) END AS coverage, quotes FROM (SELECT count(*) AS n, count(*) FILTER (WHERE match_count > 0 OR status = 'Offered') AS matched, count(*) FILTER (WHERE match_count = 0 AND status <> 'Offered' AND source = 'Instant Quote') AS quotes FROM wanted WHERE created >= DATE '{TODAY}' - {REPORT})",
    "wanted",
)
def coverage(w):
    week = w.where(F.col("created") >= F.date_sub(F.to_date(F.lit(TODAY)), REPORT))
    matched = (F.col("match_count") > 0) | (F.col("status") == "Offered")
    sums = week.agg(F.count(F.lit(1)).alias("rows"), F.count_if(matched).alias("matched"), F.count_if(~matched & F.lower("source").contains("instant quote")).alias("quotes"))
    return sums.withColumn("coverage", percent(F.col("matched"), F.col("rows")))


@query(
    "a14_clients_waiting",
    f"SELECT client, string_agg(k, ', ' ORDER BY r) AS items FROM (SELECT client, k, row_number() OVER (PARTITION BY client ORDER BY n DESC, k) AS r FROM (SELECT client, lower(brand) AS k, count(*) AS n FROM ({_SEEN}) WHERE week AND client <> '' GROUP BY 1, 2)) WHERE r <= 6 GROUP BY client",
    "wanted",
)
def clients_waiting(w):
    day = F.to_date(F.lit(TODAY))
    open_ = w.where((F.col("created") >= F.date_sub(day, REPORT)) & (F.col("match_count") == 0) & (F.col("status") != "Offered") & (F.col("client") != ""))
    counts = open_.groupBy("client", F.lower("brand").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", numbered(Window.partitionBy("client").orderBy(F.desc("n"), "k"))).where("r <= 6")
    return ranked.groupBy("client").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "k"))), lambda s: s["k"]), ", ").alias("items"))


@query("a15_phrase_counts", "SELECT lower(replace(notes, 'Unparsed: ', '')) AS phrase, count(*) AS n, count(DISTINCT supplier) AS suppliers FROM parse_rows WHERE notes LIKE 'Unparsed: %' GROUP BY 1", "parse_rows")
def phrase_counts(p):
    phrases = p.select("supplier", F.explode(F.split("notes", "\\n")).alias("line")).select("supplier", F.lower(F.regexp_extract("line", "^Unparsed:\\s*(.+?)\\s*\\z", 1)).alias("phrase"))
    return phrases.where("phrase <> ''").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("supplier").alias("suppliers"))


@query("a16_drifting_suppliers", "SELECT supplier, count(*) AS lines, count(*) FILTER (WHERE status = 'Unrecognised') AS unrecognised FROM parse_rows GROUP BY supplier HAVING count(*) >= 3 AND count(*) FILTER (WHERE status = 'Unrecognised') > 0.33 * count(*)", "parse_rows")
def drifting_suppliers(p, share: float = 0.33):
    sums = p.groupBy("supplier").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") == "Unrecognised").alias("unrecognised"))
    return sums.where((F.col("lines") >= 3) & (F.col("unrecognised") > share * F.col("lines")))


@query("a17_status_tallies", "SELECT status, count(*) AS n, count(*) FILTER (WHERE moq_type <> '') AS moq, count(lead_days) AS lead FROM parse_rows GROUP BY status", "parse_rows")
def status_tallies(p):
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("moq_type") != "").alias("moq"), F.count("lead_days").alias("lead"))


_LOG = "SELECT ord, segment, DATE '2024-01-30' - CAST(ord * 7 % 160 AS INT) AS sent_on FROM offers CROSS JOIN (SELECT DISTINCT segment FROM contacts) WHERE ord % 9 < 4"


def _log(offers, contacts):
    """What was sent: (ord, segment, sent_on). Segments are a handful of names."""
    segments = contacts.select("segment").distinct()
    sent = offers.where("ord % 9 < 4").select("ord", F.date_sub(F.to_date(F.lit(TODAY)), (F.col("ord") * 7 % 160).cast("int")).alias("sent_on"))
    named = segments.agg(F.collect_set("segment").alias("s")).select(F.explode("s").alias("segment"))
    return sent.withColumn("_j", F.lit(1)).join(F.broadcast(named.withColumn("_j", F.lit(1))), "_j").drop("_j")


_SCORE = "CASE WHEN featured THEN 40 ELSE 0 END + CASE WHEN qty > 0 THEN 5 ELSE 0 END + CASE WHEN d IS NULL THEN -10 WHEN d <= 3 THEN 30 WHEN d <= 7 THEN 20 WHEN d <= 14 THEN 10 WHEN d > 60 THEN -10 ELSE 0 END"
_SCORED = f"SELECT *, {_SCORE} AS score FROM (SELECT *, CASE WHEN offer_date = '' THEN NULL ELSE date_diff('day', CAST(offer_date AS DATE), DATE '2024-09-30') END AS d FROM offers)"


def scored(offers):
    """Freshness, featured and stock points; a missing date counts as very old."""
    days = F.coalesce(F.datediff(F.to_date(F.lit("2024-09-30")), F.try_to_date(F.nullif("offer_date", F.lit("")))), F.lit(999))
    fresh = F.when(days <= 3, 30).when(days <= 7, 20).when(days <= 14, 10).when(days > 60, -10).otherwise(0)
    return offers.withColumn("score", F.when(F.col("featured"), 40).otherwise(0) + F.when(F.col("qty") > 0, 5).otherwise(0) + fresh)


@query("f55_freshness_score", f"SELECT ord, score FROM ({_SCORED})", "offers")
def freshness_score(o):
    return scored(o).select("ord", "score")


@query("j12_cooldown", f"SELECT o.ord, s.segment FROM offers o CROSS JOIN (SELECT DISTINCT segment FROM contacts) s WHERE o.featured AND NOT EXISTS (SELECT 1 FROM ({_LOG}) l WHERE l.ord = o.ord AND l.segment = s.segment AND l.sent_on >= DATE '{TODAY}' - {COOLDOWN})", "offers", "contacts")
def cooldown(o, c):
    """Featured offers by segment that were not sent to it lately."""
    segments = c.agg(F.collect_set("segment").alias("s")).withColumn("_j", F.lit(1))
    pairs = o.where("featured").select("ord", F.lit(1).alias("_j")).join(F.broadcast(segments), "_j").select("ord", F.explode("s").alias("segment"))
    recent = _log(o, c).where(F.col("sent_on") >= F.date_sub(F.to_date(F.lit(TODAY)), COOLDOWN))
    return pairs.join(recent, ["ord", "segment"], "left_anti")


@query("t10_segment_picks", f"SELECT category, ord, r FROM (SELECT category, ord, row_number() OVER (PARTITION BY category ORDER BY score DESC, ord) AS r FROM ({_SCORED})) WHERE r <= 4", "offers")
def segment_picks(o):
    r = numbered(Window.partitionBy("category").orderBy(F.desc("score"), "ord"))
    return scored(o).select("category", "ord", r.alias("r")).where("r <= 4")


_AUDIENCE = "SELECT chat, contact_id, segment, CASE segment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS p FROM contacts WHERE chat <> '' AND chat NOT LIKE '%@g.us' AND country <> '' AND country NOT IN ('NATION_3', 'NATION_7')"


def claimed(contacts):
    """Reachable contacts in their first segment: rows whose segment is the least of their
    chat's. An include list drops blank countries, an exclude list does not."""
    p = F.when(F.col("segment") == "BUILDING", 1).when(F.col("segment") == "AUTOMOBILE", 2).when(F.col("segment") == "MACHINERY", 3).when(F.col("segment") == "HOUSEHOLD", 4).otherwise(5)
    reach = contacts.where((F.col("chat") != "") & ~F.col("chat").contains("@g.us") & (F.col("country") != "") & ~F.col("country").isin("NATION_3", "NATION_7"))
    reach = reach.select("chat", "contact_id", "segment", p.alias("p"))
    first = reach.groupBy("chat").agg(F.min("p").alias("p"))
    return reach.join(first, ["chat", "p"])


@query("p18_j10_j11_w5_priority_claim", f"SELECT chat, contact_id, segment FROM ({_AUDIENCE}) QUALIFY p = min(p) OVER (PARTITION BY chat)", "contacts")
def priority_claim(c):
    return claimed(c).select("chat", "contact_id", "segment")


@query("w6_running_cap", f"SELECT contact_id, segment, row_number() OVER (ORDER BY p, contact_id) AS r FROM (SELECT * FROM ({_AUDIENCE}) QUALIFY p = min(p) OVER (PARTITION BY chat)) QUALIFY r <= {SENDS}", "contacts")
def running_cap(c):
    """The first sends of a run, in segment order; the cap is the feature."""
    top = claimed(c).orderBy("p", "contact_id").limit(SENDS)
    return top.select("contact_id", "segment", numbered(Window.orderBy("p", "contact_id")).alias("r"))


@query("j13_a18_send_results", "SELECT segment, count(*) FILTER (WHERE contact_id % 7 <> 0) AS sent, count(*) FILTER (WHERE contact_id % 7 = 0) AS failed, array_to_string(list_sort(list(contact_id) FILTER (WHERE contact_id % 7 = 0))[1:3], ',') AS first_failures FROM contacts GROUP BY segment", "contacts")
def send_results(c):
    failed = F.when(F.col("contact_id") % 7 == 0, F.col("contact_id"))
    three = c.where("contact_id % 7 = 0").withColumn("r", numbered(Window.partitionBy("segment").orderBy("contact_id"))).where("r <= 3")
    listed = three.groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("contact_id")).cast("array<string>"), ",").alias("first_failures"))
    sums = c.groupBy("segment").agg((F.count(F.lit(1)) - F.count(failed)).alias("sent"), F.count(failed).alias("failed"))
    return sums.join(listed, "segment", "left").withColumn("first_failures", F.coalesce("first_failures", F.lit("")))


@query("a19_log_prune", f"SELECT ord, string_agg(segment || '|' || CAST(sent_on AS STRING), ';' ORDER BY segment || '|' || CAST(sent_on AS STRING)) AS log FROM (SELECT * FROM ({_LOG}) WHERE sent_on >= DATE '{TODAY}' - {KEEP} UNION ALL SELECT ord, 'NEW', DATE '{TODAY}' FROM offers WHERE featured) GROUP BY ord", "offers", "contacts")
def log_prune(o, c):
    """Each offer's log without old entries and with today's."""
    kept = _log(o, c).where(F.col("sent_on") >= F.date_sub(F.to_date(F.lit(TODAY)), KEEP))
    new = o.where("featured").select("ord", F.to_date(F.lit(TODAY)).alias("sent_on"), F.lit("NEW").alias("segment"))
    lines = kept.unionByName(new).select("ord", F.concat_ws("|", "segment", F.col("sent_on").cast("string")).alias("line"))
    return lines.groupBy("ord").agg(F.array_join(F.array_sort(F.collect_list("line")), ";").alias("log"))


@query("p17_x32_card_fields", "SELECT ord, name || ' · ' || spec AS headline, CASE WHEN featured THEN 'TRADER PICK' WHEN amount < 1000 THEN 'SHARP PRICE' ELSE '' END AS badge FROM offers WHERE amount IS NOT NULL", "offers")
def card_fields(o):
    badge = F.when(F.col("featured"), F.lit("TRADER PICK")).when(F.col("amount") < 1000, F.lit("SHARP PRICE")).otherwise(F.lit(""))
    return o.where("amount IS NOT NULL AND name <> ''").select("ord", F.concat_ws(" · ", "name", "spec").alias("headline"), badge.alias("badge"))
