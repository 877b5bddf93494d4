"""Offers, guards and trade terms read from messages.

The oracles read the same texts by patterns of their own, made for the parts that the views
put together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import extraction, terms
from tradewind.functions.spans import found, merged, without
from tradewind.functions.sqltext import S, applied
from tradewind.operators import quarantine
from tradewind.operators.chat_offers import ATTRIBUTES, TERMS, chat_offers, offer_lines
from tradewind.operators.terms import with_line_terms
from tradewind.plans.registry import query

_P = "(?i)(?:EUR ?[0-9]+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)? ?(?:€|AED))(?: ?(?:/|per ) ?(?:btl|pcs|case))?"


def _sized(x: str) -> str:
    return f"regexp_matches({x}, '(?i)[0-9] ?(?:ml|cl|g)\\b|[0-9] ?[x×/] ?[0-9]')"


def _bare(x: str) -> str:
    gone = f"trim(regexp_replace(regexp_replace({x}, '{_P}', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({gone}, '(?i)(?:[\\s–@|,;-]|(?:\\bprices?)?\\s*:)+$', ''), '^[\\s–@|-]+', ''))"


_LOOSE = "(?i)^(?:ftl\\b|[0-9][0-9,. ]*(?:cs|cases|btls|pcs|loads|truckloads)\\b|exw\\b)"
_FRONT = "(?i)^(?:ftl|[0-9][0-9,. ]*(?:cs|cases|btls|pcs|loads|truckloads))\\b"

#: Lines of a message, then its decided rows with names split from quantities.
_LINES = f"""
split AS (
    SELECT message_id, text, own_incoterm, own_lead, unnest(range(1, len(parts) + 1)) AS pos, parts
    FROM (SELECT *, string_split(regexp_replace(replace(text, 'dhs', 'AED'), '[*_~`]+', ' ', 'g'), chr(10)) AS parts FROM messages)
), lines AS (
    SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY pos) - 1 AS line_no
    FROM (SELECT message_id, own_incoterm, own_lead, pos, trim(regexp_replace(parts[pos], '[ \\t]+', ' ', 'g')) AS line FROM split) WHERE line <> ''
), priced AS (
    SELECT *, regexp_extract_all(line, '{_P}') AS ps, regexp_matches(line, '(?i)^(?:bbd|moq|ean|lead time)[ :-]+[0-9]') AS is_attribute,
           right(line, 1) = '?' AS asks, regexp_matches(line, 'EUR 5 - EUR 6') AS is_range, contains(line, ' about ') AS inexact
    FROM lines
), cut AS (
    SELECT *, CASE WHEN len(ps) > 0 THEN trim(left(line, strpos(line, ps[1]) - 1)) ELSE line END AS head,
           CASE WHEN len(ps) > 0 THEN substr(line, strpos(line, ps[1]) + length(ps[1])) ELSE '' END AS tail,
           {_bare("line")} AS bare_line, regexp_replace(ps[1], '(?i) ?per ', '/') AS token
    FROM priced
), told AS (
    SELECT *, coalesce(last_value(CASE WHEN {_sized("line")} AND len(ps) = 0 AND NOT is_attribute AND NOT asks THEN line END IGNORE NULLS)
        OVER (PARTITION BY message_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS heading
    FROM cut
), whole AS (
    SELECT message_id, count(*) FILTER (len(ps) > 0 AND {_sized("head")}) AS listed, bool_or(is_range) AS any_range, count(*) FILTER (len(ps) > 0) AS n_priced,
           len(list_distinct(list_transform(flatten(list(ps)), lambda q: lower(replace(regexp_replace(q, '(?i) ?per ', '/'), ' ', ''))))) AS n_tokens,
           min(line_no) FILTER (len(ps) > 0) AS first_priced,
           coalesce(min_by(bare_line, line_no) FILTER (NOT is_attribute AND NOT asks AND {_sized("line")} AND {_sized("bare_line")}),
                    min_by(line, line_no) FILTER (NOT is_attribute AND NOT asks AND len(ps) = 0 AND regexp_matches(line, '[A-Za-z]{{3}}')), '') AS name,
           string_agg(line, chr(10) ORDER BY line_no) AS body
    FROM told GROUP BY message_id
), decided AS (
    SELECT t.message_id, t.line_no, 'list' AS mode, head AS base, heading, tail, t.line AS scope, t.own_incoterm, t.own_lead,
           CASE WHEN NOT {_sized("head")} THEN 'no size' WHEN is_range THEN 'price range' WHEN inexact THEN 'approximate price' ELSE '' END AS reason, token, body
    FROM told t JOIN whole w ON w.message_id = t.message_id WHERE w.listed >= 2 AND len(ps) > 0 AND head <> ''
    UNION ALL
    SELECT t.message_id, t.line_no, 'single', name, heading, tail, body, t.own_incoterm, t.own_lead,
           CASE WHEN any_range THEN 'price range' WHEN n_priced = 0 THEN 'no price' WHEN n_tokens > 1 THEN 'several prices' WHEN inexact THEN 'approximate price'
                WHEN name = '' THEN 'no product' ELSE '' END, token, body
    FROM told t JOIN whole w ON w.message_id = t.message_id WHERE w.listed < 2 AND t.line_no = coalesce(first_priced, 0)
), parted AS (
    SELECT *, regexp_split_to_array(CASE WHEN {_bare("base")} = '' THEN base ELSE {_bare("base")} END, '\\s+[–—-]\\s+') AS parts FROM decided
), loose AS (
    SELECT *, list_position(list_transform(list_reverse(parts[2:]), lambda t: regexp_matches(trim(t), '{_LOOSE}')), false) AS k FROM parted
), dropped AS (
    SELECT *, CASE WHEN coalesce(k, 0) = 0 THEN len(parts) - 1 ELSE k - 1 END AS n FROM loose
), fronted AS (
    SELECT *, trim(array_to_string(parts[1:len(parts) - n], ' - ')) AS front, trim(array_to_string(list_transform(parts[len(parts) - n + 1:], lambda t: trim(t)), ' ')) AS behind FROM dropped
), named AS (
    SELECT *, regexp_extract(front, '{_FRONT}') AS lead_qty FROM fronted
), offer_rows AS (
    SELECT *, CASE WHEN goes THEN trim(substr(front, length(lead_qty) + 1)) ELSE front END AS product,
           CASE WHEN goes AND behind <> '' THEN lead_qty || ' ' || behind WHEN goes THEN lead_qty ELSE behind END AS qty,
           CASE WHEN reason = '' THEN token ELSE '' END AS price
    FROM (SELECT *, lead_qty <> '' AND trim(substr(front, length(lead_qty) + 1)) <> '' AS goes FROM named)
)"""


@query(
    "p15_buy_side_guard",
    f"SELECT message_id, CASE WHEN regexp_matches(replace(text, 'dhs', 'AED'), '{_P}') AND NOT contains(lower(text), 'can you match') THEN 'Supplier Offer' ELSE 'Other' END AS kind FROM messages",
    "messages",
)
def buy_side_guard(m):
    text = extraction.clean(F.col("text"))
    return m.select("message_id", F.when(extraction.is_supplier_offer(text), F.lit("Supplier Offer")).otherwise(F.lit("Other")).alias("kind"))


@query("x15_x21_offer_lines", f"WITH {_LINES} SELECT message_id, line_no AS line, mode, product, qty, heading, price, reason FROM offer_rows", "messages")
def offers_of_messages(m):
    """Offers and refusals of each message, in one frame."""
    return offer_lines(m).select("message_id", F.col("line").cast("long").alias("line"), "mode", "product", "qty", "heading", "price", "reason")


def _read(x: str) -> str:
    """The terms that the text x states, as SQL columns of a subquery."""
    place = f"CASE WHEN regexp_matches({x}, '(?i)\\bloen\\b') THEN 'Loendersloot' WHEN contains({x}, 'Poland') THEN 'Poland' WHEN contains({x}, 'Riga') THEN 'Riga' END"
    code = f"nullif(upper(regexp_extract({x}, '(?i)\\b(exw|dap)\\b', 1)), '')"
    stretch = f"list_transform(regexp_split_to_array({x}, '[\\n|]'), lambda t: trim(t))"
    lead = "nullif(coalesce(nullif(regexp_extract(t, '(?i)lead time:? ([^.]*)$', 1), ''), regexp_extract(t, '^([0-9]+-[0-9]+ weeks)', 1)), '')"
    return f"""{{'incoterm': coalesce({code}, CASE WHEN regexp_matches({x}, '(?i)\\bex loen\\b') THEN 'EXW' END), 'warehouse': {place},
        'bond': CASE WHEN regexp_matches({x}, '\\bT1\\b') THEN 'T1' END, 'lead': list_filter(list_transform({stretch}, lambda t: {lead}), lambda v: v IS NOT NULL)[1],
        'moq': list_filter(list_transform({stretch}, lambda t: nullif(regexp_extract(t, '(?i)\\bmoq[ :]+([^.]*)', 1), '')), lambda v: v IS NOT NULL)[1]}}"""


def _sourced(term: str, given: str) -> str:
    whole = f"CASE WHEN NOT unsure THEN wide.{term} END" if term == "warehouse" else f"wide.{term}"
    return f"""coalesce(own.{term}, {whole}, nullif({given}, ''), '') AS {term},
        CASE WHEN own.{term} IS NOT NULL THEN 'line' WHEN {whole} IS NOT NULL THEN 'message' WHEN nullif({given}, '') IS NOT NULL THEN 'supplier' ELSE '' END AS {term}_source"""


_GIVEN = {"incoterm": "own_incoterm", "lead": "own_lead"}


@query(
    "x22_x23_x24_offer_terms",
    f"""WITH {_LINES}, read AS (
        SELECT *, {_read("(tail || chr(10) || scope)")} AS own, {_read("body")} AS wide, contains(body, 'EXW Poland or') AS unsure,
               regexp_extract(replace(qty || ' ' || replace(scope, chr(10), ' '), ' cases per pallet', ''), '(?i)([0-9][0-9,]*) (?:cs|cases)\\b', 1) AS stock, regexp_extract(scope, '([0-9]+) cases per pallet', 1) AS pallet, regexp_extract(scope, '([0-9]+) pcs per case', 1) AS each
        FROM offer_rows)
    SELECT message_id, line_no AS line, {", ".join(_sourced(t, _GIVEN.get(t, "NULL::VARCHAR")) for t in TERMS)},
        CAST(nullif(replace(stock, ',', ''), '') AS BIGINT) AS stock_cases, CAST(nullif(pallet, '') AS BIGINT) AS cases_per_pallet, CAST(nullif(each, '') AS BIGINT) AS pcs_case,
        CASE WHEN contains(scope, 'bbd 04/2028') THEN '04/2028' END AS bbd, nullif(regexp_extract(scope, 'EAN: ([0-9]{{13}})', 1), '') AS ean
    FROM read""",
    "messages",
)
def terms_of_offers(m):
    """Terms and attributes of each offer, every term with the scope that it came from."""
    given = m.withColumn("supplier", F.struct(F.col("own_incoterm").alias("incoterm"), F.col("own_lead").alias("lead")))
    sourced = [c for t in TERMS for c in (t, f"{t}_source")]
    return chat_offers(given, "supplier").select("message_id", F.col("line").cast("long").alias("line"), *sourced, *ATTRIBUTES)


_VOWELS = "[aeiou]"


@query(
    "x5_x11_x16_merged_spans",
    """WITH texts AS (SELECT p_partkey, p_name || ' (' || lower(p_type) || ') ' || p_brand AS text FROM part),
       spans AS (SELECT p_partkey, text, i - 1 AS a, least(i - 1 + 1 + p_partkey % 4, length(text)) AS b
                 FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM texts) WHERE substr(text, i, 1) IN ('a', 'e', 'i', 'o', 'u')),
       marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY p_partkey ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM spans),
       islands AS (SELECT p_partkey, text, min(a) AS a, max(b) AS b FROM (SELECT *, sum(begins) OVER (PARTITION BY p_partkey ORDER BY a) AS island FROM marked) GROUP BY p_partkey, text, island),
       pieces AS (SELECT *, substr(text, 1 + coalesce(lag(b) OVER w, 0), a - coalesce(lag(b) OVER w, 0)) AS piece, lead(a) OVER w IS NULL AS last FROM islands WINDOW w AS (PARTITION BY p_partkey ORDER BY a))
       SELECT t.p_partkey, coalesce(s.n, 0) AS n_spans, coalesce(p.n, 0) AS n_merged, coalesce(p.covered, 0) AS covered, coalesce(p.rest, t.text) AS rest
       FROM texts t LEFT JOIN (SELECT p_partkey, count(*) AS n FROM spans GROUP BY 1) s ON s.p_partkey = t.p_partkey
       LEFT JOIN (SELECT p_partkey, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS covered, string_agg(piece, '~' ORDER BY a) || '~' || max(CASE WHEN last THEN substr(text, b + 1) END) AS rest FROM pieces GROUP BY p_partkey) p ON p.p_partkey = t.p_partkey""",
    "part",
)
def merged_spans(part):
    """Overlapping spans of a text, their union, and the text rebuilt from the gaps."""
    texts = part.select("p_partkey", F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(") "), "p_brand").alias("text"))

    def spans(text: S, wide: S) -> S:
        return S.transform(found(text, _VOWELS), lambda s: S.struct(s["start"].alias("start"), S.least(s["end"] + wide, S.length(text)).alias("end")))

    read = texts.withColumn("spans", applied(spans, F.col("text"), (F.col("p_partkey") % 4).cast("int")))
    union = applied(merged, F.col("spans"))
    sized = F.aggregate("union", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rest = applied(lambda t, s: without(t, s, "~"), F.col("text"), F.col("spans"))
    return read.withColumn("union", union).select("p_partkey", F.size("spans").cast("long").alias("n_spans"), F.size("union").cast("long").alias("n_merged"), sized.alias("covered"), rest.alias("rest"))


@query(
    "x2_fail_open_rows",
    """SELECT row_id, CAST(q AS DECIMAL(12, 2)) AS qty, d AS offered, CAST(k AS BIGINT) AS k,
        CASE WHEN bad_q OR bad_d OR bad_p THEN 'Unrecognised' ELSE 'ok' END AS status,
        concat_ws(' · ', CASE WHEN bad_q THEN 'Parser error: qty ' || qty END, CASE WHEN bad_d THEN 'Parser error: offered ' || offered END, CASE WHEN bad_p THEN 'Parser error: props ' || trim(props) END) AS note
       FROM (SELECT *, try_cast(nullif(qty, '') AS DOUBLE) AS q, try_cast(offered AS DATE) AS d, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k,
            nullif(qty, '') IS NOT NULL AND try_cast(qty AS DOUBLE) IS NULL AS bad_q, offered IS NOT NULL AND try_cast(offered AS DATE) IS NULL AS bad_d, props IS NOT NULL AND NOT json_valid(props) AS bad_p FROM raw_rows)""",
    "raw_rows",
)
def fail_open(rows):
    """All rows, the broken ones with their errors and what of them could be read."""
    read = quarantine.typed(rows, {"qty": "decimal(12,2)", "offered": "date"}, {"props": "k bigint"})
    status = F.when(F.size("errors") > 0, "Unrecognised").otherwise("ok")
    return read.select("row_id", "qty", "offered", F.col("props.k").alias("k"), status.alias("status"), quarantine.note().alias("note"))


def _amount(x: str) -> str:
    n = f"regexp_extract({x}, '([0-9][0-9.,]*[0-9]|[0-9])', 1)"
    return f"CAST(nullif(regexp_replace({n}, '[.,]', '', 'g'), '') AS DOUBLE) * CASE WHEN regexp_matches({x}, '[0-9]k') THEN 1000 ELSE 1 END"


def _moq(x: str, cell: bool) -> str:
    """A struct of the minimum stated in x, or null."""
    cur = f"upper(regexp_extract({x}, '(?i)\\b(usd|eur|gbp|chf)\\b', 1))"
    cases = f"CAST(nullif(regexp_extract({x}, '([0-9]+) cases', 1), '') AS DOUBLE)"
    row = lambda kind, qty="NULL::DOUBLE", currency="''", note="''", bare="NULL::DOUBLE": f"{{'type': {kind}, 'qty': {qty}, 'currency': {currency}, 'note': {note}, 'bare': {bare}}}"
    both = f"CASE WHEN {cases} IS NOT NULL THEN '{terms.BOTH}' ELSE '' END"
    refused = "'The minimum is stated in CHF, which MOQ Currency has no option for — the amount was read but not published'"
    told = f"""WHEN regexp_matches({x}, '(?i)no minimum') THEN {row("'No Minimum'")} WHEN {cur} = 'CHF' THEN {row("'Applies — Unspecified'", note=refused)}
        WHEN {cur} <> '' THEN {row("'Order Value'", _amount(x), cur, both)} WHEN {cases} IS NOT NULL THEN {row("'Cases'", cases)}"""
    if cell:
        return f"CASE {told} WHEN regexp_matches({x}, '^MOQ: [0-9]') THEN {row(repr(terms.UNSPECIFIED), bare=_amount(x))} END"
    return f"CASE WHEN NOT regexp_matches({x}, '(?i)\\b(?:moq|minimum|min order|min =)') THEN NULL {told} END"


_TERM_ORACLE = f"""
WITH plain AS (
    SELECT line_id, trim(coalesce(name, '')) AS name, trim(coalesce(moq, '')) AS moq, trim(coalesce(lead, '')) AS lead, trim(coalesce(notes, '')) AS notes, trim(coalesce(header, '')) AS header,
        CASE default_unit WHEN 'Cases' THEN 'Cases' WHEN 'pallets' THEN 'Pallets' END AS d_type, CASE WHEN default_qty > 0 THEN CAST(default_qty AS DOUBLE) END AS d_qty, default_days AS d_days
    FROM term_lines
), read AS (
    SELECT *, {_moq("moq", True)} AS m_cell, {_moq("name", False)} AS m_name, {_moq("notes", False)} AS m_notes, {_moq("header", False)} AS m_head,
        CASE WHEN lead = 'READY' THEN 0 WHEN lead = '2-3 weeks' THEN 21 WHEN lead = '10 working days' THEN 14 ELSE CAST(nullif(regexp_extract(lead, '^([0-9]+) days$', 1), '') AS INT) END AS l_cell,
        7 * CAST(nullif(regexp_extract(name, '(?i)lead time (?:[0-9]+-)?([0-9]+) weeks', 1), '') AS INT) AS l_name,
        CASE WHEN contains(notes, '48 hours') THEN 2 END AS l_notes, CAST(nullif(regexp_extract(header, 'Lead time ([0-9]+) days', 1), '') AS INT) AS l_head,
        CASE WHEN contains(notes, 'full pallets only') THEN false WHEN contains(notes, 'can be mixed') THEN true WHEN contains(header, 'mixed') THEN true END AS mixed
    FROM plain
), own AS (
    SELECT *, coalesce(m_cell, m_name, m_notes, m_head) AS m, coalesce(l_cell, l_name, l_notes, l_head) AS l, m_cell IS NULL AND m_name IS NOT NULL AS moves_m, l_cell IS NULL AND l_name IS NOT NULL AS moves_l FROM read
), sorted AS (
    SELECT *, m.bare IS NOT NULL AND d_type IS NOT NULL AS borrows, m.bare IS NOT NULL AND d_type IS NULL AS lacks,
        CASE WHEN moves_m THEN regexp_replace(name, '(?i)(?:moq|min =) [0-9]+ cases', ' ') ELSE name END AS without_m
    FROM own
), cleaned AS (
    SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN moves_l THEN regexp_replace(without_m, '(?i)lead time [0-9-]+ weeks', ' ') ELSE without_m END, '[\\s—-]+$', ''), '\\s+', ' ', 'g')) AS product_name FROM sorted
), said AS (
    SELECT *, CASE WHEN borrows THEN d_type WHEN m IS NOT NULL THEN m.type ELSE d_type END AS moq_type,
        concat_ws(' · ', CASE WHEN m IS NOT NULL AND m_cell IS NULL AND m_name IS NULL AND m_notes IS NULL THEN '{terms.FROM_HEADER[0]}' END,
            CASE WHEN l IS NOT NULL AND l_cell IS NULL AND l_name IS NULL AND l_notes IS NULL THEN '{terms.FROM_HEADER[1]}' END,
            CASE WHEN borrows THEN 'Quantity ' || CAST(CAST(m.bare AS BIGINT) AS STRING) || ' was stated without a unit; the supplier''s default unit (' || d_type || ') was used' END,
            CASE WHEN lacks THEN '"' || CAST(CAST(m.bare AS BIGINT) AS STRING) || '" was stated as a minimum with no unit — MOQ Qty left blank rather than guessed' END,
            nullif(m.note, ''), CASE WHEN (moves_m OR moves_l) AND product_name <> name THEN '{terms.MOVED}' END) AS remarks,
        concat_ws(' | ', CASE WHEN m_cell IS NULL AND moq <> '' THEN moq END, CASE WHEN m_cell IS NULL AND m_name IS NULL AND m_notes IS NULL AND contains(notes, 'MOQ on request') THEN notes END,
            CASE WHEN l_cell IS NULL AND lead <> '' THEN lead END, CASE WHEN lacks OR contains(m.note, 'CHF') THEN moq END) AS unrecognised
    FROM cleaned
)
SELECT line_id, product_name, moq_type, CASE WHEN borrows THEN m.bare WHEN m IS NOT NULL THEN m.qty WHEN d_type IS NOT NULL THEN d_qty END AS moq_qty, CASE WHEN moq_type = 'Order Value' THEN m.currency ELSE '' END AS moq_currency,
    CASE WHEN m_cell IS NOT NULL THEN 'Supplier Stated' WHEN m IS NOT NULL THEN 'Parsed From Text' WHEN d_type IS NOT NULL THEN 'Supplier Default' ELSE '' END AS moq_source, mixed,
    coalesce(l, d_days) AS lead_days, CASE WHEN l_cell IS NOT NULL THEN 'Supplier Stated' WHEN l IS NOT NULL THEN 'Parsed From Text' WHEN d_days IS NOT NULL THEN 'Supplier Default' ELSE '' END AS lead_source,
    CASE WHEN moq_type IS NULL AND coalesce(l, d_days) IS NULL THEN 'Unrecognised' WHEN moq_type IS NOT NULL AND coalesce(l, d_days) IS NOT NULL AND unrecognised = '' THEN 'Clean' ELSE 'Partial' END AS status, remarks, unrecognised
FROM said"""


@query("x1_x14_trade_terms", _TERM_ORACLE, "term_lines")
def trade_terms(t):
    """Terms of each line, with their sources, remarks and what could not be read."""
    read = with_line_terms(t, terms.supplier_default(F.col("default_qty"), F.col("default_unit"), F.col("default_days")))
    joined = F.array_join("remarks", " · ").alias("remarks"), F.array_join("unrecognised", " | ").alias("unrecognised")
    return read.select("line_id", "product_name", "moq_type", "moq_qty", "moq_currency", "moq_source", F.col("mixed_load").alias("mixed"), "lead_days", "lead_source", "status", *joined)


@query("x26_x27_wanted_lines", "SELECT wanted_id, 'W-IQ-' || CAST(wanted_id AS STRING) || '-' || CAST(n AS STRING) AS line_id, lower(brand) AS brand FROM wanted CROSS JOIN range(1, 3) t(n) WHERE match_count = 0 AND (n = 1 OR product <> '')", "wanted")
def wanted_lines(w):
    """One row for each unmatched line of an enquiry."""
    lines = F.array_compact(F.array(F.col("brand"), F.nullif("product", F.lit(""))))
    each = w.where("match_count = 0").select("wanted_id", F.lower("brand").alias("brand"), F.posexplode(lines).alias("n", "asked"))
    return each.select("wanted_id", F.concat_ws("-", F.lit("W-IQ"), F.col("wanted_id").cast("string"), (F.col("n") + 1).cast("string")).alias("line_id"), "brand")
