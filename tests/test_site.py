"""Pages, redirects, related lines and page texts on odd rows."""

import json

from pyspark.sql import functions as F

from tradewind.functions import offers
from tradewind.operators import intake_payload, site
from tradewind.sources import readers

SCHEMA = "ord long, name string, spec string, brand string, category string, delisted boolean, other string"


def test_pages_suffixes_live_first(spark):
    rows = [(1, "Rosé", "75cl", None, "Wine", True, "x"), (2, "Rose", "75cl", "A", "Wine", False, "y"), (3, "Rosé", "75cl", "A", "Wine", False, "z"), (4, None, None, None, None, False, None)]
    got = {r["ord"]: (r["slug"], r["legacy_slug"], r["other"]) for r in site.pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2: ("rose-75cl", "rose-75cl", "y"), 3: ("rose-75cl-2", "ros-75cl", "z"), 1: ("rose-75cl-3", "ros-75cl-2", "x"), 4: ("", "", None)}
    assert site.pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redirects_never_lead_from_a_live_page(spark):
    rows = [(1, "Rosé", "", "Moët", "Wine", False, ""), (2, "Ros", "", "Moët", "Wine", False, ""), (3, "Café", "", "MOET", "Wine", False, ""), (4, "Tea", "", "MOET", "Wine", False, "")]
    placed = site.pages(spark.createDataFrame(rows, SCHEMA))
    pages = spark.createDataFrame([("moet-wholesale", ["Moët", "MOET"])], "slug string, variants array<string>")
    retired = spark.createDataFrame([("/offers/caf/", "/brands/moet-wholesale/"), ("/offers/gone/", "/category/wine/")], "source string, target string")
    rules = site.moved(placed, pages, retired)
    # "Ros" is a live page of its own under the new rule, so the old path of "Rosé" stays with it, and its second row moves.
    assert {(r["section"], r["source"], r["target"], r["bare"]) for r in rules.collect()} == {
        (1, "/offers/caf/", "/offers/cafe/", True), (1, "/offers/ros-2/", "/offers/ros/", True),
        (2, "/brands/mot-wholesale/", "/brands/moet-wholesale/", True), (3, "/offers/gone/", "/category/wine/", False),
    }
    assert {r["line"] for r in site.redirect_lines(rules.where("section > 1")).collect()} == {"/brands/mot-wholesale/ /brands/moet-wholesale/ 301", "/brands/mot-wholesale /brands/moet-wholesale/ 301", "/offers/gone/ /category/wine/ 301"}


def plain_related(rows):
    """Each row's lines, one after the other."""
    live = [r for r in rows if not r["delisted"]]
    out = {}
    for r in rows:
        others = [x["ord"] for x in live if x["category"] == r["category"] and x["category"] is not None and x["ord"] != r["ord"]]
        mine = [x["ord"] for x in live if x["category"] == r["category"]]
        turn = sum(map(ord, r["slug"])) if r["delisted"] else mine.index(r["ord"])
        window = [others[(turn + k) % len(others)] for k in range(min(8, len(others)))]
        key = (r["brand"] or "").strip().lower()
        same = [x["ord"] for x in live if key and (x["brand"] or "").strip().lower() == key and x["ord"] != r["ord"]][:4]
        out[r["ord"]] = (same + [x for x in window if x not in same])[:4]
    return out


def test_related_lines_equal_plain_ones(spark):
    made = [(k, f"n{k}", "", ["Hot", " hot", "b", "", None, "c", "solo" + str(k)][k % 7], ["x", "y", "z", None][(k * k) % 4] if k != 50 else "alone", k % 9 == 4, "") for k in range(60)]
    placed = site.pages(spark.createDataFrame(made, SCHEMA)).cache()
    rows = sorted(placed.collect(), key=lambda r: r["ord"])
    got = {r["ord"]: [] for r in rows}
    for r in site.related(placed).orderBy("ord", "place").collect():
        got[r["ord"]].append(r["related"])
    assert got == plain_related(rows)


def test_a_sitemap_escapes_and_lists_once(spark):
    listed = spark.createDataFrame([(1, "R & D", False, "a", "a"), (2, "R & D", False, "b", "a"), (3, None, True, "c", "c"), (4, "", True, "d", "a"), (5, "", False, "e", None)], "ord long, category string, delisted boolean, slug string, canonical_slug string")
    pages = spark.createDataFrame([("x-wholesale",)], "slug string")
    entries = site.sitemap(listed, pages, [("/about/", "yearly", "0.1")])
    assert sorted((r["list"], r["path"]) for r in entries.collect()) == [(1, "/"), (2, "/category/r-&-d/"), (3, "/brands/"), (4, "/brands/x-wholesale/"), (5, "/offers/a/"), (5, "/offers/e/"), (6, "/offers/c/"), (7, "/about/")]
    assert "<loc>https://s.example/category/r-&amp;-d/</loc>" in entries.where("list = 2").select(site.sitemap_entry("https://s.example", "2024-01-01")).first()[0]


def test_ledger_entries_are_json(spark):
    ledger = spark.createDataFrame([("b", 'O"Neil', None, "2024-01-02"), ("a", "", "Wine", "2024-01-01")], "slug string, brand string, category string, retired_on string")
    lines = [r["line"] for r in site.ledger_lines(ledger).orderBy("slug").collect()]
    assert json.loads("{" + ",".join(lines) + "}") == {"a": ["", "Wine", "2024-01-01"], "b": ['O"Neil', "", "2024-01-02"]}


def test_facts_of_a_brand(spark):
    rows = [
        (1, "b", "T1", 10.0, "EUR", "case", " Rotterdam ", "EXW", 700, "Beer"), (2, "b", "Bonded", 9.5, "EUR", "case", "Riga", "DAP", 1750, "Beer"), (3, "b", "T2", 1.0, "USD", "bottle", "Riga", "DAP", 333, "Beer"),
        (4, "b", None, None, "EUR", None, None, None, None, "Beer"), (5, "b", "", 3.0, None, "unit", "", "", 0, None), (6, "c", "T1", 5.0, "GBP", "loose", "Riga", "", 1000, "Beer"), (7, "c", "", 5.0, "", "case", "", "", -5, "Odd"), (8, "", "", 5.0, "EUR", "case", "", "", 1, "Odd"),
    ]
    df = spark.createDataFrame(rows, "ord long, brand string, tier string, amount double, currency string, price_basis string, warehouse string, incoterm string, volume_ml int, category string")
    got = {r["key"]: r.asDict() for r in site.brand_facts(df, F.col("brand"), F.when(F.col("category") == "Beer", "a truck")).collect()}
    assert set(got) == {"b", "c"}
    b, c = got["b"], got["c"]
    assert (b["offers"], b["under_bond"], b["duty_paid"], b["incoterm"], b["more_sizes"], b["minimum"]) == (5, 2, 1, "DAP", 0, "a truck")
    assert (b["floors"], b["places"], b["sizes"]) == (["EUR 9.50 per case", "USD 1.00 per bottle or unit"], ["Riga", "Rotterdam"], ["333ml", "70cl", "1.75L"])
    assert (c["offers"], c["floors"], c["places"], c["sizes"], c["minimum"], c["incoterm"]) == (2, [], ["Riga"], ["1L"], None, None)
    many = df.limit(1).crossJoin(spark.range(1, 15)).withColumn("volume_ml", F.col("id") * 10)
    assert [(len(r["sizes"]), r["more_sizes"]) for r in site.brand_facts(many, F.col("brand"), F.lit("x")).collect()] == [(10, 4)]


def test_product_data_leaves_out_what_is_unknown(spark):
    schema = "name string, slug string, spec string, tier string, price_detail string, brand string, category string, amount double, currency string, price_basis string, stock string, qty long, terms string, origin string, delisted boolean"
    rows = [('Dry "Gin"', "gin", "6 x 70cl", "T1", "EUR 9", "B", "Spirits", 9.0, "EUR", "per case", "enq", 1200, "EXW", "France", False), ("Ale", "ale", None, None, None, None, None, 0.0, None, None, None, None, None, None, True)]
    full, bare = [json.loads(r[0]) for r in spark.createDataFrame(rows, schema).select(offers.product_data("https://s.example", F.lit("2024-02-15").cast("date"))).collect()]
    assert bare == {"@context": "https://schema.org", "@type": "Product", "name": "Ale", "url": "https://s.example/offers/ale/", "description": "Ale, wholesale."}
    assert full["offers"]["price"] == "9.00" and "availability" not in full["offers"] and full["offers"]["eligibleQuantity"] == {"@type": "QuantitativeValue", "unitText": "case", "minValue": 1}
    assert full["offers"]["priceValidUntil"] == "2024-02-15" and [p["value"] for p in full["additionalProperty"]] == ["6 x 70cl", "T1", "EXW", "1,200 cases", "France"]


def test_quote_views_of_any_shape(spark):
    bodies = ['{"results": [{"match": {}, "lineSaving": 2}, {"match": null, "needsReview": true, "lineSaving": -1}, {}]}', "[]", None]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string")
    lines = df.select("k", F.posexplode(intake_payload.quoted(intake_payload.parsed(F.col("b")))).alias("n", "q"))
    assert {(r["view"], r["n"]) for r in intake_payload.views(lines).collect()} == {("all", 0), ("all", 1), ("all", 2), ("saving", 0), ("review", 1), ("unmatched", 1), ("unmatched", 2)}


def test_hash_parts_cover_every_row(spark):
    """Predicates as a database would run them, with a hash of either sign and none."""
    rows = spark.createDataFrame([(h,) for h in (-(1 << 31), -7, -1, 0, 1, 6, (1 << 31) - 1, None)], "h int")
    tests = [p.replace("hashtext(h)", "h") for p in readers.hash_parts("h", 3)]
    assert [sum(1 for t in tests if rows.where(t).where(f"h <=> {h}").count()) for h in ("-2147483648", "-7", "-1", "0", "1", "6", "2147483647", "NULL")] == [1] * 8


def test_a_snapshot_may_be_read_while_it_is_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "snap"), "id string, n int"
    df = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    assert readers.write_if_changed(df, path, schema)
    own = readers.snapshot(spark, path, schema)
    assert not readers.write_if_changed(own, path, schema)
    assert readers.write_if_changed(own.withColumn("n", F.col("n") + 1), path, schema)
    assert sorted(r["n"] for r in readers.snapshot(spark, path, schema).collect()) == [2, 3]
    assert [p.name for p in tmp_path.iterdir()] == ["snap"]


def test_lines_in_order(spark, tmp_path):
    path = str(tmp_path / "lines")
    df = spark.createDataFrame([(f"k{n:03d}", f"line {n}") for n in range(200)], "slug string, line string").repartition(7)
    readers.write_ordered(df, path, "slug")
    files = sorted((tmp_path / "lines").glob("part-*"))
    assert [x for f in files for x in f.read_text().splitlines()] == [f"line {n}" for n in range(200)]
