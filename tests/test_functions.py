"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tradewind.functions import brands, offers, words
from tradewind.plans import search


def values(spark, function, inputs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(function(F.col("v"))).collect()]


def test_volumes(spark):
    assert values(spark, offers.volume_ml, ["6 x 70cl x 40% alc", "24 x 440ml", "1.5L", "500 g", "0ml", None, ""]) == [700, 440, 1500, None, None, None, None]


def test_clean_names(spark):
    got = values(spark, offers.clean_name, ["Harbour Gin (6 × 20 CL):", "lot 77 on pallet Price:", "plain", " ,; ", None])
    assert got == ["Harbour Gin (6 × 20 CL)", "lot 77 on pallet", "plain", "", ""]


def test_slugs(spark):
    assert values(spark, brands.slug, ["Moët & Chandon", "L'Oréal Paris", "  a -- b  ", "ß"]) == ["moet-chandon", "loreal-paris", "a-b", "ss"]
    assert len(values(spark, brands.slug, ["x" * 200])[0]) == 90


def test_barcode_keys(spark):
    assert values(spark, brands.ean_key, ["0 5012345 678900", "123", "", None]) == ["5012345678900", None, None, None]


def test_brands(spark):
    assert values(spark, brands.clean_brand, [" two ", "1664", "Dove", None]) == ["", "1664", "Dove", ""]
    assert values(spark, brands.is_shouting, ["NIVEA", "Nivea", "X", "P&G"]) == [True, False, False, True]


def test_terms_amounts(spark):
    assert values(spark, offers.terms_amount, ["35k", "1.5m", "35.000", "35 000", "70,75", "x"]) == [35000.0, 1500000.0, 35000.0, 35000.0, 70.75, None]


@pytest.mark.parametrize(("days", "label"), [(0, "Ex-stock"), (1, "1 day"), (7, "1 week"), (10, "10 days"), (21, "3 weeks"), (None, "")])
def test_lead_labels(spark, days, label):
    assert spark.createDataFrame([(days,)], "d int").select(offers.lead_label(F.col("d"))).first()[0] == label


def test_search_ranks_exact_before_fuzzy(spark):
    docs = spark.createDataFrame([(1, "Guinness", "24x 440ml"), (2, "Guiness Stout", "24x 330ml"), (3, "Heineken", "24x 330ml")], "ord long, name string, spec string")
    postings = search.index(docs, ["name"], ["spec"])
    rows = {r["ord"]: (r["score"], r["matched"]) for r in search.search(postings, "guinness 440ml").collect()}
    assert rows == {1: (3.0, 2)}
    rows = {r["ord"]: r["matched"] for r in search.search(postings, "guinness 999ml").collect()}
    assert rows == {1: 1, 2: 1}


def test_search_words(spark):
    pairs = {
        "Barrel Stout 24 x 330ml": "barrel stout 24x 330ml", "33cl": "330ml", "12x330": "12x 330ml", "4x6x33cl": "4x 6x 330ml", "75cl": "750ml", "2L": "2000ml",
        "1 liter": "1000ml", "0.5": "500ml", "Gin 0.7": "gin 700ml", "6x0.7": "6x 700ml", "12 x 35cl x 38% alc": "12x 350ml 38%", "Stout Draft": "stout draught",
        "Rye Whisky": "rye whiskey", "D'Orée Café": "doree cafe", "Lager 250ml btl": "lager 250ml bottle", "Cola cans": "cola can", "Bar 51g": "bar 51g",
        "Spread 1,5 kg": "spread 1500g", "1,000 pcs": "1000 piece", "40.5 %": "40 5%", "guinness": "guinness", "berries": "berry", None: "", "the x of": "",
        "oil 8 oz": "oil 227g", "T1 2024": "t1 2024",
    }
    assert values(spark, words.normalise, list(pairs)) == list(pairs.values())


def test_search_without_words_gives_all_rows(spark):
    docs = spark.createDataFrame([(1, "Stout", "24x 440ml"), (2, "Ale", "24x 330ml")], "ord long, name string, spec string")
    assert search.search(search.index(docs, ["name"], ["spec"]), "the x").count() == 2


def test_buyers_and_durations(spark):
    from tradewind.functions import extraction

    told = ["Please share your best price, EUR 5/btl", "Cola EUR 5/btl", "we want to buy at 5 EUR", "requesting a quotation: 5 EUR", "Rum, no price"]
    assert values(spark, extraction.is_supplier_offer, told) == [False, True, False, False, False]
    assert values(spark, extraction.lead_days, ["2-3 weeks", "10 working days", "36 hrs", "1 month", "5 working weeks", "ready to ship", "soon"]) == [21, 14, 2, 30, 35, 0, None]


def test_lines_of_an_enquiry(spark):
    from pyspark.sql import functions as F

    from tradewind.functions import intake

    rows = [
        ("Green Valley Oat Drink Original 6 x 1L", None, None),
        ("2 trays", "chf", "n/a"),
        ("Tall Ship cases of dark rum AED 9", "EUR", "-3"),
        ("", "", ""),
        (None, None, "12 pcs"),
    ]
    df = spark.createDataFrame(rows, "text string, currency string, qty string")
    text = F.col("text")
    brand = intake.brand_of(text)
    got = df.select(brand, intake.variant_of(text, brand), intake.first_kind(text, intake.CATEGORIES), intake.first_kind(text, intake.UNITS), intake.currency_of(text, F.col("currency")), intake.positive_number(F.col("qty"))).collect()
    assert [tuple(r) for r in got] == [
        ("Green Valley Oat Drink", "Original 6 x 1L", "", "", "", None),
        ("", "2 trays", "", "", "Other", None),
        ("Tall Ship", "cases of dark rum AED 9", "Spirits", "Cases", "AED", None),
        ("", "", "", "", "", None),
        ("", "", "", "", "", 12.0),
    ]


def test_client_names(spark):
    from pyspark.sql import functions as F

    from tradewind.functions import intake

    rows = [(None, ["rec00000000000001", " Ann "], None), (" Bo ", ["x"], None), (None, None, "call\r\nBuyer: Cy\r\n"), (None, [], "Buyer: unattributed"), (None, None, None)]
    df = spark.createDataFrame(rows, "cached string, links array<string>, notes string")
    got = df.select(intake.client_name(*map(F.col, df.columns))).collect()
    assert [r[0] for r in got] == ["Ann", "Bo", "Cy", "", ""]


def test_search_requests_round_trip():
    from tradewind.operators.search_request import SearchRequest

    full = SearchRequest.from_query("?q=caf%C3%A9+x&cat=A%2CB,C%26D&stock=1&cur=usd&min=1.5&max=oops&sort=old&view=table")
    assert full == SearchRequest("café x", "rel", True, "USD", 1.5, None, "table", {"cat": ["A", "B", "C&D"]})
    assert SearchRequest.from_query(full.to_query()) == full
    assert SearchRequest.from_query("").to_query() == "" and SearchRequest.from_query("?cat=,,&min=").facets == {}
    assert SearchRequest("00012345678, 1234567").barcodes() is None and SearchRequest("00012345678\n12345678").barcodes() == ["12345678", "12345678"]
    assert SearchRequest("gin 12345678").barcodes() is None and SearchRequest(" ").barcodes() is None


def test_persistent_index_reads_only_matching_buckets(spark):
    from tradewind.operators.search_index import SearchIndex

    docs = spark.createDataFrame([(k, f"word{k} common", "6 x 330ml", None) for k in range(50)] + [(60, None, None, None), (None, "word1", "", None)], "ord long, name string, spec string, token string")
    index = SearchIndex.build(docs, ["name"], ["spec"], buckets=16)
    found = index.search("word7")
    assert [tuple(r) for r in found.collect()] == [(7, 2.0, 1)]
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a partition for each file that is read
    read = index.postings().rdd.getNumPartitions(), index.postings().where("token IN ('word7')").rdd.getNumPartitions()
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert read[0] > 8 and read[1] == 1
    assert index.search("the").count() == 52 and index.search("zzz zzz").count() == 0
    assert {r["ord"] for r in index.search("word1 qqqqqq").collect()} == {1, None, *range(10, 20)}
    plain = {tuple(r) for r in search.search(search.index(docs, ["name"], ["spec"]), "comon 330ml").collect()}
    assert {tuple(r) for r in index.search("comon 330ml").collect()} == plain and len(plain) == 50
    empty = SearchIndex.build(docs.where("false"), ["name"], ["spec"])
    assert empty.search("word7").count() == 0 and empty.search("").count() == 0
