"""Span algebra, lexicons, trade terms and chat offers on texts of many shapes."""

import random

import pytest
from pyspark.sql import functions as F

from tradewind.functions import messages, spans, terms
from tradewind.functions.sqltext import S, applied
from tradewind.operators import quarantine
from tradewind.operators.chat_offers import chat_offers, offer_lines
from tradewind.operators.terms import with_line_terms


def values(spark, build, inputs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(build(F.col("v"))).collect()]


def test_found_spans_equal_a_scan(spark):
    import re

    r = random.Random(4)
    texts = ["".join(r.choice("ab1 2é\n") for _ in range(r.randint(0, 30))) for _ in range(60)] + ["", "11", None]
    got = values(spark, lambda c: applied(lambda t: spans.found(t, "[0-9]+"), c), texts)
    assert [g if g is None else [tuple(s) for s in g] for g in got] == [t if t is None else [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t)] for t in texts]


def test_union_and_gaps_equal_a_mark_for_each_character(spark):
    r = random.Random(5)
    rows = []
    for k in range(80):
        text = "".join(r.choice("abcdefghij") for _ in range(r.randint(0, 25)))
        cuts = [sorted((r.randint(0, len(text)), r.randint(0, len(text)))) for _ in range(r.randint(0, 6))]
        rows.append((k, text, [tuple(c) for c in cuts]))
    df = spark.createDataFrame(rows, "k int, text string, cuts array<struct<start:int,end:int>>").orderBy("k")
    got = df.select(applied(spans.merged, F.col("cuts")), applied(lambda t, s: spans.without(t, s, "~"), F.col("text"), F.col("cuts"))).collect()
    for (_, text, cuts), (union, rest) in zip(rows, got):
        inside = [any(a <= k < b for a, b in cuts) for k in range(len(text))]
        merged = []
        for a, b in sorted(c for c in cuts if c[0] < c[1]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        assert [list(s) for s in union] == merged
        assert rest.replace("~", "") == "".join(c for c, i in zip(text, inside) if not i) and rest.count("~") == len(merged)


def test_names_without_spans(spark):
    span = lambda *cuts: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in cuts))
    cases = [("Old Gin (net) 70cl", [(9, 12)], "Old Gin 70cl"), ("Old Gin - 5 days", [(10, 16)], "Old Gin"), ("ab 5 days", [(3, 9)], "ab 5 days"), ("Old Gin", [], "Old Gin"), ("Old , Gin", [(0, 3), (2, 5)], "Gin")]
    for text, cuts, expected in cases:
        df = spark.createDataFrame([(text,)], "t string")
        cut = span(*cuts) if cuts else F.array().cast("array<struct<start:int,end:int>>")
        assert df.select(applied(spans.name_without, F.col("t"), cut)).first()[0] == expected


def test_constants_of_sql_text(spark):
    odd = ["it's", "back\\slash", "line\nend", "é😀", '"q"']
    assert [spark.range(1).select(applied(lambda x: S.lit(v), F.col("id"))).first()[0] for v in odd] == odd  # noqa: B023
    got = spark.range(3).select(applied(lambda x: S.when(x == 1, "one").when(x > 1, S.lit(None)).otherwise("none"), F.col("id"))).collect()
    assert [r[0] for r in got] == ["none", "one", None]


CELLS = {
    "Minimum shipment EUR 4,500": ("Order Value", 4500.0, "EUR", None), "12.500 USD minimum": ("Order Value", 12500.0, "USD", None), "min £2 500": ("Order Value", 2500.0, "GBP", None),
    "MOQ EUR 9k or 300 ctns": ("Order Value", 9000.0, "EUR", None), "minimum 70,000 SEK": ("Applies — Unspecified", None, "", None), "moq 75 ctns": ("Cartons", 75.0, "", None),
    "MOQ 30-60 pcs": ("Pieces", 30.0, "", None), "4 plts": ("Pallets", 4.0, "", None), "2 full truck loads": ("Full Truckload", 2.0, "", None), "3 x 20ft": ("Container", 3.0, "", None),
    "40 feet container": ("Container", None, "", None), "full pallets": ("Pallets", 1.0, "", None), "any quantity": ("No Minimum", None, "", None), "MOQ: nil": ("No Minimum", None, "", None),
    "MOQ = 80": ("Applies — Unspecified", None, "", 80.0), "subject to MOQ": ("Applies — Unspecified", None, "", None), "on request": None, "": None, None: None,
}


def test_minimum_orders_of_cells(spark):
    got = values(spark, lambda c: terms.minimum_order(c, cell=True), list(CELLS))
    assert [g and (g["type"], g["qty"], g["currency"], g["bare"]) for g in got] == list(CELLS.values())


def test_terms_in_free_text_have_places(spark):
    texts = ["Harbour Gin 6x70cl MOQ 40 cases", "20 cases minimum | Rum 70cl", "price 5; minimum order EUR 1,000", "Gin 40 cases", "Gin (delivery 3-4 weeks) 70cl", "Gin, ex stock"]
    moq = values(spark, terms.minimum_order, texts)
    assert [g and texts[k][g["start"] : g["end"]] for k, g in enumerate(moq)] == ["MOQ 40 cases", "20 cases minimum", "minimum order EUR 1,000", None, None, None]
    lead = values(spark, terms.lead_time, texts)
    assert [g and (g["days"], texts[k][g["start"] : g["end"]]) for k, g in enumerate(lead)] == [None, None, None, None, (28, "delivery 3-4 weeks"), (0, "ex stock")]


def test_lead_times_of_cells(spark):
    cases = {"4 wks": 28, "3 to 5 days": 5, "15 business days": 21, "72 hrs": 3, "overnight": 1, "ready": 0, "ready to quote": None, "in stock, 6 days": 6, "not in stock": None, "on the floor": 0, "2 mths": 60}
    assert values(spark, terms.lead_days, list(cases)) == list(cases.values())


def test_line_terms_cascade(spark):
    schema = "name string, moq string, lead string, notes string, header string, unit string, qty int, days int"
    rows = [
        ("Harbour Gin 70cl MOQ 40 cases", None, None, None, "Lead time 6 days", "Pallets", 3, 20),
        ("Harbour Rum", None, None, None, "", "pallets", 3, 20),
        ("Harbour Rum", "60", "whenever", "mixed pallets", None, "btls", 3, None),
        ("Harbour Rum", "60", None, None, None, "odd", 3, -1),
        (None, None, None, None, None, None, None, None),
    ]
    out = with_line_terms(spark.createDataFrame(rows, schema), terms.supplier_default(F.col("qty"), F.col("unit"), F.col("days")))
    got = {tuple(r[c] for c in schema.replace(" string", "").replace(" int", "").split(", ")): r for r in out.collect()}
    picked = [(r["product_name"], r["moq_type"], r["moq_qty"], r["moq_source"], r["lead_days"], r["lead_source"], r["mixed_load"], r["status"], len(r["remarks"]), r["unrecognised"]) for r in (got[k] for k in rows)]
    assert picked == [
        ("Harbour Gin 70cl", "Cases", 40.0, "Parsed From Text", 6, "Parsed From Text", None, "Clean", 2, []),
        ("Harbour Rum", "Pallets", 3.0, "Supplier Default", 20, "Supplier Default", None, "Clean", 0, []),
        ("Harbour Rum", "Bottles", 60.0, "Supplier Stated", None, "", True, "Partial", 1, ["whenever"]),
        ("Harbour Rum", "Applies — Unspecified", None, "Supplier Stated", None, "", None, "Partial", 1, ["60"]),
        ("", None, None, "", None, "", None, "Unrecognised", 0, []),
    ]


NAMES = {
    "Harbour Dry 1l x 6, coded 300 crt Price: EUR 12.40": "Harbour Dry 1l x 6, coded 300 crt",
    "Harbour Dry (12 × 35 CL): 5,20 €": "Harbour Dry (12 × 35 CL)",
    "Harbour Dry 1l x 12, Price: 9,95 EUR": "Harbour Dry 1l x 12",
    "Harbour Dry 6x1L 37.5% – FTL @ EUR 5.95/btl": "Harbour Dry 6x1L 37.5%",
    "two loads Harbour Dry 70 cl EUR 13.20": "Harbour Dry 70 cl",
    "3 truckloads Pale Lager 24x330ml EUR 11.00/cs": "Pale Lager 24x330ml",
    "Two Rivers Rum 70cl EUR 9.50": "Two Rivers Rum 70cl",
    "1000 Lakes Vodka 70cl EUR 4.10": "1000 Lakes Vodka 70cl",
    "Stock Clearance: Pale Lager 24x330ml EUR 4": "Pale Lager 24x330ml",
    "we are offering: Blue Soap\nEUR 2/pc": "Blue Soap",
    "Would 5.65 EUR work for 700ml?": "",
}


def test_product_names(spark):
    df = spark.createDataFrame(list(enumerate(NAMES)), "k int, text string")
    assert [r["product"] for r in offer_lines(df).orderBy("k", "line").collect()] == list(NAMES.values())


MESSAGES = {
    "": [],
    "hello": [("single", "hello", "", "no price")],
    "A 70cl EUR 1/btl\nB 50cl @ 2,10 €": [("list", "A 70cl", "EUR 1/btl", ""), ("list", "B 50cl", "2,10 €", "")],
    "A 70cl EUR 1\nB 50cl EUR 2 - 3\nC 50cl about EUR 4\nLoose EUR 5": [("list", "A 70cl", "EUR 1", ""), ("list", "B 50cl", "", "price range"), ("list", "C 50cl about", "", "approximate price"), ("list", "Loose", "", "no size")],
    "A 70cl\nall EUR 3\npallet EUR 4": [("single", "A 70cl", "", "several prices")],
    "A 70cl\nall EUR 3\nalso eur 3": [("single", "A 70cl", "EUR 3", "")],
    "EUR 3 - EUR 4": [("single", "", "", "price range")],
}


def test_lists_singles_and_refusals(spark):
    df = spark.createDataFrame(list(enumerate(MESSAGES)) + [(99, None)], "k int, text string")
    got = {}
    for r in offer_lines(df).orderBy("k", "line").collect():
        got.setdefault(r["k"], []).append((r["mode"], r["product"], r["price"], r["reason"]))
    assert got == {k: v for k, v in enumerate(MESSAGES.values()) if v}


def test_headings_are_carried(spark):
    text = "Gin range 70cl\nDry EUR 1\n\nRum range 6 x 1l\nbbd 04/2030\nDark 70cl EUR 2\nLight 70cl EUR 3"
    rows = offer_lines(spark.createDataFrame([(text,)], "text string")).orderBy("line").collect()
    assert [(r["line"], r["heading"], r["reason"]) for r in rows] == [(1, "Gin range 70cl", "no size"), (4, "Rum range 6 x 1l", ""), (5, "Rum range 6 x 1l", "")]


def test_terms_and_their_sources(spark):
    text = "Parcel (Ex Loen | 6-7 weeks)\nA 70cl – 1,250 cs @ EUR 1 | DAP Riga | lead time 3 days\nB 50cl EUR 2 T2"
    df = spark.createDataFrame([(text, {"incoterm": "FOB", "moq": "9 cases", "bond": ""})], "text string, given struct<incoterm:string,moq:string,bond:string>")
    a, b = chat_offers(df, "given").orderBy("line").collect()
    pick = lambda r: [(r[t], r[f"{t}_source"]) for t in ("incoterm", "warehouse", "bond", "lead", "moq")]
    assert pick(a) == [("DAP", "line"), ("Riga", "line"), ("T2", "message"), ("3 days", "line"), ("9 cases", "supplier")] and a["stock_cases"] == 1250
    assert pick(b) == [("DAP", "message"), ("Loendersloot", "message"), ("T2", "line"), ("6-7 weeks", "message"), ("9 cases", "supplier")]
    one = "A 90g\n18 pcs/box\n48 cases per pallet\nbbd 04/2030\nEAN: 5012345678900\n1,02€\nbbd: 05/2031 - 06/2031"
    (r,) = chat_offers(spark.createDataFrame([(one,)], "text string")).collect()
    assert (r["stock_cases"], r["cases_per_pallet"], r["pcs_case"], r["bbd"], r["ean"], r["moq_source"]) == (None, 48, 18, "04/2030", "5012345678900", "")


@pytest.mark.parametrize("text", ["A EUR 5, can you beat it?", "what's your best price? ours is EUR 5", "we are looking to buy at EUR 5", "kindly share your quotation, last EUR 5", "I'd like a quote near 5 EUR"])
def test_buyers(spark, text):
    assert values(spark, messages.is_supplier_offer, [text, "do you need A? EUR 5"]) == [False, True]


def test_quarantine_keeps_every_row(spark):
    rows = [("1", "2024-01-05", '{"k": 3}'), ("x", "2024-13-05", "{"), (None, " ", ""), ("2.5", None, '{"k": "no"}')]
    read = quarantine.typed(spark.createDataFrame([(*r, 7) for r in rows], "n string, d string, j string, errors int"), {"n": "int", "d": "date"}, {"j": "k bigint"})
    assert read.count() == quarantine.good(read).count() + quarantine.bad(read).count() == 4
    assert sorted(r["note"] for r in quarantine.bad(read).collect()) == ['Parser error: n 2.5 · Parser error: j {"k": "no"}', "Parser error: n x · Parser error: d 2024-13-05 · Parser error: j {"]
    assert quarantine.good(read).where("j.k = 3").count() == 1
