"""Text search with typo tolerance, and faceted counts, over the catalogue."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions import offers as fn
from tradewind.functions import words
from tradewind.functions.js import numbered
from tradewind.operators import search_request as sr
from tradewind.operators.search_index import index_of, match, postings
from tradewind.plans.registry import query

def index(docs: DataFrame, strong: list[str], weak: list[str], key: str = "ord") -> DataFrame:
    """(key, token, weight): each token of a row once, strong before weak."""
    return postings(docs, strong, weak, key)


def search(rows: DataFrame, text: str, key: str = "ord") -> DataFrame:
    """SearchIndex.search over postings that lie in no table of their own."""
    spark = rows.sparkSession
    asked = spark.sql("SELECT :text AS text", args={"text": text}).select(F.array_distinct(words.tokens(F.col("text")))).first()[0]
    if not asked:
        return rows.select(key).distinct().select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"))
    wanted = spark.createDataFrame([(w,) for w in asked], "q string")
    base = match(F.col("q"), F.col("token"))
    matches = rows.select("token").distinct().join(F.broadcast(wanted), base.isNotNull()).select("token", "q", base.alias("base"))
    best = rows.join(matches, "token").groupBy(key, "q").agg(F.max(F.col("base") * F.col("weight")).alias("s"))
    found = best.groupBy(key).agg(F.sum(F.col("s").cast("decimal(10,4)")).cast("double").alias("score"), F.count(F.lit(1)).alias("matched"))
    need = found.agg(F.when(F.max("matched") >= len(asked), len(asked)).otherwise(max(len(asked) - 1, 1)).alias("need"))
    return found.join(F.broadcast(need), F.col("matched") >= F.col("need")).select(key, "score", "matched")


#: Strong and weak fields of the catalogue's index.
FIELDS = ["brand", "name"], ["spec", "category", "tier"]
_SAME = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.SYNONYMS.items())
_STOP = ", ".join(f"'{w}'" for w in words.STOP)
#: The words of a text whose only sizes are "6 x 110ml": packs are joined, then plain runs.
_WORDS = f"list_transform(list_filter(regexp_extract_all(regexp_replace(lower({{}}), '([0-9]) x ([0-9])', '\\1x \\2', 'g'), '[a-z0-9%]+'), lambda w: w NOT IN ({_STOP})), lambda w: CASE w {_SAME} ELSE w END)"
_STEMS = f"list_filter(list_transform({_WORDS}, lambda w: CASE WHEN NOT regexp_matches(w, '^[a-z]{{{{5,}}}}$') OR regexp_matches(w, '(ss|us|is|ys)$') THEN w WHEN suffix(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END), lambda w: w NOT IN ({_STOP}))"
_TOKENS = f"SELECT ord, unnest(list_distinct({_STEMS})) AS token, {{}} AS weight FROM offers"
_INDEX = f"SELECT ord, token, max(weight) AS weight FROM ({_TOKENS.format('brand || chr(32) || name', 2)} UNION ALL {_TOKENS.format('spec || chr(32) || category || chr(32) || tier', 1)}) GROUP BY ord, token"


@query("f1_f2_tokens", f"SELECT ord, array_to_string({_STEMS.format("name || ' bottles ' || spec || ' x 40% alc'")}, ' ') AS words FROM offers", "offers")
def normalised_texts(o: DataFrame) -> DataFrame:
    text = F.concat(F.col("name"), F.lit(" BOTTLES "), F.col("spec"), F.lit(" × 40 % alc"))
    return o.select("ord", words.normalise(text).alias("words"))


@query(
    "f6_f7_f8_stems",
    f"SELECT ord, array_to_string({_STEMS.format("CASE ord % 4 WHEN 0 THEN 'berries glass whiskies' WHEN 1 THEN 'creme brulee crates' WHEN 2 THEN 'tins of days chips' ELSE 'loreal gel citrus' END")}, ' ') AS words FROM offers",
    "offers",
)
def stemmed_texts(o: DataFrame) -> DataFrame:
    text = F.when(F.col("ord") % 4 == 0, "Berries Glass Whiskies").when(F.col("ord") % 4 == 1, "Crème brûlée CRATES").when(F.col("ord") % 4 == 2, "Tins of days, chips").otherwise("L'Oréal Gel citrus")
    return o.select("ord", words.normalise(text).alias("words"))


@query("q1_build_index", f"SELECT token, count(*) AS docs, CAST(sum(weight) AS BIGINT) AS weight FROM ({_INDEX}) GROUP BY token", "offers")
def build_index(o: DataFrame) -> DataFrame:
    """Writes the index and gives its vocabulary."""
    return index_of(o, *FIELDS, fresh=True).words()


def _search_sql(asked: list[str]) -> str:
    values = ", ".join(f"('{w}')" for w in asked)
    near = "regexp_matches(q, '^[a-z]+$') AND regexp_matches(token, '^[a-z]+$') AND levenshtein(q, token) <= CASE WHEN length(q) >= 8 THEN 2 WHEN length(q) >= 4 THEN 1 ELSE 0 END AND length(q) >= 4"
    base = f"CASE WHEN q = token THEN 1.0 WHEN length(q) >= 2 AND starts_with(token, q) THEN 0.6 WHEN {near} THEN 0.45 END"
    return f"""WITH p AS ({_INDEX}), m AS (SELECT token, q, {base} AS base FROM (SELECT DISTINCT token FROM p) CROSS JOIN (VALUES {values}) t(q) WHERE {base} IS NOT NULL),
        r AS (SELECT ord, CAST(sum(s) AS DOUBLE) AS score, count(*) AS matched FROM (SELECT ord, q, max(base * weight) AS s FROM p JOIN m USING (token) GROUP BY ord, q) GROUP BY ord)
        SELECT ord, score, matched FROM r WHERE matched >= (SELECT CASE WHEN max(matched) >= {len(asked)} THEN {len(asked)} ELSE {max(len(asked) - 1, 1)} END FROM r)"""


@query("q2_j9_search_typo", _search_sql(["110ml", "widgt"]), "offers")
def search_typo(o: DataFrame) -> DataFrame:
    return index_of(o, *FIELDS).search("widgt 110ml")


@query("q2_search_fallback", _search_sql(["red", "wid", "zzzzzz"]), "offers")
def search_fallback(o: DataFrame) -> DataFrame:
    return index_of(o, *FIELDS).search("red wid zzzzzz")




def facets() -> list[tuple[str, Column]]:
    """Facet keys and the value that each shows for a row."""
    return [
        ("cat", F.col("category")),
        ("brand", F.col("brand")),
        ("size", fn.volume_label(F.col("volume_ml"))),
        ("pack", F.col("pack").cast("string")),
        ("bond", F.when(F.col("tier") == "", F.lit("Enquire")).otherwise(F.col("tier"))),
        ("wh", F.col("warehouse")),
        ("inco", F.col("incoterm")),
        ("moq", fn.moq_bucket(F.col("moq_type"))),
        ("lead", fn.lead_bucket(F.col("lead_time_days"))),
    ]


def passed(docs: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """docs with `fv`, the facet values, and `bits`, one for each facet that a row passes."""
    bits = F.lit(0)
    for i, (key, value) in enumerate(facets()):
        ok = value.isin(chosen[key]) if chosen.get(key) else F.lit(True)
        bits = bits + F.when(ok, 1 << i).otherwise(0)
    return docs.withColumn("fv", F.array(*[value for _, value in facets()])).withColumn("bits", bits)


def facet_counts(docs: DataFrame, chosen: dict[str, list[str]], other: Column) -> DataFrame:
    """(facet, value, n): for each facet the rows that pass all others. One scan, one
    partial aggregation; selected values are listed even at zero."""
    names = [key for key, _ in facets()]
    every = (1 << len(names)) - 1
    rows = passed(docs, chosen).where(other).select("bits", F.posexplode("fv").alias("i", "value"))
    without = F.lit(every) - F.call_function("shiftleft", F.lit(1), F.col("i"))
    some = rows.where((F.col("bits").bitwiseAND(without) == without) & F.col("value").isNotNull() & (F.col("value") != ""))
    facet = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    counts = some.groupBy(facet.alias("facet"), "value").agg(F.count(F.lit(1)).alias("n"))
    picked = [(key, value) for key, values in chosen.items() for value in values]
    zero = docs.sparkSession.createDataFrame(picked or [("", "")], "facet string, value string").where("facet <> ''").withColumn("n", F.lit(0).cast("long"))
    return counts.union(zero).groupBy("facet", "value").agg(F.max("n").alias("n"))


_LABEL = "CASE WHEN volume_ml IS NULL OR volume_ml <= 0 THEN '' WHEN volume_ml >= 1000 AND volume_ml % 100 = 0 THEN rtrim(rtrim(printf('%.2f', volume_ml / 1000.0), '0'), '.') || 'L' ELSE CAST(volume_ml AS STRING) || 'ml' END"
_VALUES = {
    "cat": "category",
    "brand": "brand",
    "size": _LABEL,
    "pack": "CAST(pack AS STRING)",
    "bond": "CASE WHEN tier = '' THEN 'Enquire' ELSE tier END",
    "wh": "warehouse",
    "inco": "incoterm",
    "moq": "CASE moq_type WHEN '' THEN '' WHEN 'No Minimum' THEN 'No minimum' WHEN 'Order Value' THEN 'Minimum order value' WHEN 'Container' THEN 'Full load only' WHEN 'Pallets' THEN 'Pallet minimum' ELSE 'Unit minimum' END",
    "lead": "CASE WHEN lead_time_days IS NULL THEN '' WHEN lead_time_days = 0 THEN 'Ex-stock' WHEN lead_time_days <= 7 THEN 'Within a week' WHEN lead_time_days <= 28 THEN '1–4 weeks' ELSE 'Over 4 weeks' END",
}
CHOSEN = {"cat": ["ECONOMY", "SMALL"], "bond": ["T1", "Enquire"], "wh": ["Nowhere", "Harbour"]}


def _facets_sql(chosen: dict[str, list[str]], other: str) -> str:
    test = lambda key: f"{_VALUES[key]} IN ({', '.join(repr(v) for v in chosen[key])})" if key in chosen else "true"
    each = [f"SELECT '{key}' AS facet, {_VALUES[key]} AS value, 1 AS n FROM offers WHERE {other} AND {' AND '.join(test(k) for k in _VALUES if k != key)}" for key in _VALUES]
    each += [f"SELECT '{key}', '{value}', 0" for key, values in chosen.items() for value in values]
    return "SELECT facet, value, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(each) + ") WHERE value <> '' GROUP BY facet, value"


@query("q3_facet_counts", _facets_sql(CHOSEN, "stock = 'in'"), "offers")
def q3(o: DataFrame) -> DataFrame:
    """Self-excluding counts with stock only; Q3, Q8 and Q9."""
    return facet_counts(o, CHOSEN, F.col("stock") == "in")


@query("q4_currency_counts", f"SELECT currency, count(*) AS n FROM offers WHERE {_VALUES['cat']} IN ('ECONOMY') GROUP BY currency", "offers")
def currency_counts(o: DataFrame) -> DataFrame:
    every = (1 << len(facets())) - 1
    return passed(o, {"cat": ["ECONOMY"]}).where(F.col("bits") == every).groupBy("currency").agg(F.count(F.lit(1)).alias("n"))


@query("q5_q10_price_range", "SELECT ord, p AS price FROM (SELECT ord, currency, coalesce(CASE WHEN price_basis IN ('case', 'pack') THEN floor(amount / pack * 10000 + 0.5) / 10000 END, amount) AS p FROM offers) WHERE currency = 'EUR' AND p >= 50 AND p <= 1000", "offers")
def price_range(o: DataFrame) -> DataFrame:
    """Bounds count only with a currency; a row without price fails a bound."""
    unit = F.when(F.col("price_basis").isin("case", "pack"), F.floor(F.col("amount") / F.col("pack") * 10000 + 0.5) / 10000)
    return o.select("ord", "currency", F.coalesce(unit, F.col("amount")).alias("price")).where("currency = 'EUR' AND price >= 50 AND price <= 1000").select("ord", "price")


@query("t11_facet_chips", f"SELECT facet, value, n, r FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM ({_facets_sql({}, 'true')})) WHERE r <= 14", "offers")
def facet_chips(o: DataFrame) -> DataFrame:
    counts = facet_counts(o, {}, F.lit(True))
    return counts.withColumn("r", numbered(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where("r <= 14")


#: Links as buyers share them; each is planned on its own.
LINKS = [
    "?q=widgt+110ml&stock=1",
    "?q=050000004%2C%2070000015&sort=asc",
    "?q=50000008;00050000010&cat=SMALL,ECONOMY",
    "?cat=ECONOMY,PROMO&bond=T1,Enquire&cur=eur&min=900&max=950.5&sort=desc",
    "?q=red&wh=North%20Depot&sort=new&view=table",
    "?stock=1&inco=EXW",
    "?q=the%20x&moq=Pallet+minimum&cur=USD&min=oops",
    "?q=zzzzzz",
]
_PRICE = "coalesce(CASE WHEN price_basis IN ('case', 'pack') THEN floor(amount / pack * 10000 + 0.5) / 10000 END, amount)"


def _priced() -> Column:
    unit = F.when(F.col("price_basis").isin("case", "pack"), F.floor(F.col("amount") / F.col("pack") * 10000 + 0.5) / 10000)
    return F.coalesce(unit, F.col("amount"))


def _by_hand(asked: list[str] | None, where: str) -> str:
    """Rows of one link: found by words or not, and the filters written out."""
    rows = f"SELECT ord, {_PRICE} AS price, currency, stock, featured, offer_date FROM offers WHERE {where}"
    if asked is None:
        return f"SELECT *, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS matched FROM ({rows})"
    return f"SELECT o.*, f.score, f.matched FROM ({rows}) o JOIN ({_search_sql(asked)}) f ON f.ord = o.ord"


def _codes(*keys: str) -> str:
    listed = ", ".join(f"'{k}'" for k in keys)
    return f"(ltrim(ean, '0') IN ({listed}) OR ltrim(ean_case, '0') IN ({listed}))"


_HAND = [
    (_by_hand(["widgt", "110ml"], "stock = 'in'"), "matched DESC, score DESC, ord"),
    (_by_hand(None, _codes("50000004", "70000015")), "price IS NULL, CASE WHEN price IS NOT NULL THEN currency END, price, ord"),
    (_by_hand(None, f"{_codes('50000008', '50000010')} AND category IN ('SMALL', 'ECONOMY')"), "matched DESC, score DESC, ord"),
    (_by_hand(None, f"category IN ('ECONOMY', 'PROMO') AND tier IN ('T1', '') AND currency = 'EUR' AND {_PRICE} >= 900 AND {_PRICE} <= 950.5"), "price IS NULL, CASE WHEN price IS NOT NULL THEN currency END, price DESC, ord"),
    (_by_hand(["red"], "warehouse = 'North Depot'"), "offer_date DESC, ord"),
    (_by_hand(None, "stock = 'in' AND incoterm = 'EXW'"), "featured DESC, ord"),
    (_by_hand(None, "moq_type = 'Pallets' AND currency = 'USD'"), "matched DESC, score DESC, ord"),
    (_by_hand(["zzzzzz"], "true"), "matched DESC, score DESC, ord"),
]
_REQUESTS = " UNION ALL ".join(f"SELECT {k} AS link, ord, price, score, matched FROM ({rows})" for k, (rows, _) in enumerate(_HAND))
_PAGES = " UNION ALL ".join(
    f"SELECT {k} AS link, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position, ord FROM ({rows}) QUALIFY position <= {sr.PAGE}" for k, (rows, order) in enumerate(_HAND)
)


def _links(o: DataFrame) -> list[tuple[sr.SearchRequest, DataFrame]]:
    index = index_of(o, *FIELDS)
    requests = [sr.SearchRequest.from_query(link) for link in LINKS]
    return [(r, sr.results(o, index, facets(), _priced(), r)) for r in requests]


@query("q6_q7_requests", _REQUESTS, "offers")
def requested_rows(o: DataFrame) -> DataFrame:
    """All rows that each link shows: by barcodes, by words or all, then its filters."""
    each = [rows.select(F.lit(k).alias("link"), "ord", "price", "score", "matched") for k, (_, rows) in enumerate(_links(o))]
    return functools.reduce(DataFrame.unionByName, each)


@query("q7_t1_first_pages", _PAGES, "offers")
def first_pages(o: DataFrame) -> DataFrame:
    """The first page of each link, in its order."""
    each = [sr.page(rows, r).select(F.lit(k).alias("link"), "position", "ord") for k, (r, rows) in enumerate(_links(o))]
    return functools.reduce(DataFrame.unionByName, each)
