"""Views from allow-lists, positions, key figures and enquiries on odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from tradewind.operators import guards, intake_payload, positions, public_view, publication, slugs
from tradewind.operators.public_view import Field


def test_guards_in_order():
    names = ["Supplier", "Public Note", "note", "notes", "MOQ Source", "Lead Source", "Buy Now", "Created By", "created_at", "Price Level", "Price", "wa group", "warehouse", "Payment Terms", "Terms"]
    assert guards.forbidden(names) == ["Supplier", "notes", "Lead Source", "Buy Now", "Created By", "Price Level", "wa group", "Payment Terms"]
    assert guards.is_forbidden("Public Note", "buy_price") and not guards.is_forbidden("Public Note", "public_note")


def test_a_view_has_the_listed_columns_or_none(spark):
    spark.createDataFrame([(1, "a", 5.0, None), (2, "b", 6.0, "x")], "id int, name string, buy_price double, deleted_at string").createOrReplaceTempView("offers_base")
    fields = [Field("Record", "id"), Field("Name", "name"), Field("Size", "size", "length(b.name)"), Field("Deleted", "deleted_at", only_filter=True)]
    view = public_view.create(spark, "offers_public_test", "offers_base", fields, "b.deleted_at IS NULL", temporary=True)
    assert view.columns == ["id", "name", "size", "deleted_at"] and [tuple(r) for r in view.collect()] == [(1, "a", 1, None)]
    audited = public_view.audit(spark, {"offers_public_test": fields, "offers_base": None})
    assert {(r["object"], r["statuses"]) for r in public_view.privileges(audited).collect()} == {("offers_public_test", "filter,public"), ("offers_base", "not listed")}
    for wrong in (Field("Supplier Email", "mail"), Field("Public Note", "buy_price"), Field("Nice Name", "buy_price"), Field("Odd", "id; drop"), Field("Again", "name")):
        with pytest.raises(ValueError, match="cannot be published"):
            public_view.create(spark, "offers_public_wrong", "offers_base", [*fields, wrong], temporary=True)
    assert "offers_public_wrong" not in {t.name for t in spark.catalog.listTables()}


def test_positions_and_zips(spark):
    left = spark.createDataFrame([(k * 7 - 30, f"l{k}") for k in range(40)] + [(None, "lost")], "ord long, v string").repartition(5)
    right = spark.createDataFrame([(k, f"r{k}") for k in range(25)], "ord long, v string")
    both = {r["position"]: (r["left"] and r["left"]["v"], r["right"] and r["right"]["v"]) for r in positions.zipped(left, right, "ord", bits=3).collect()}
    assert both == {k + 1: (f"l{k}", f"r{k}" if k < 25 else None) for k in range(40)}
    assert positions.zipped(left.where("false"), right, "ord").where("left IS NULL").count() == 25


def test_legacy_slugs_follow_the_locale(spark):
    rows = ["zebra", "Zebra", "ZEBRA", "zèbra", "Ångström", "angstrom", "!!", " "] * 2 + ["once"]
    got = {r["brand"]: r["slug"] for r in slugs.legacy_brand_slugs(spark.createDataFrame([(b,) for b in rows], "brand string")).collect()}
    assert got == {"zebra": "zebra-wholesale", "Zebra": "zebra-wholesale-2", "ZEBRA": "zebra-wholesale-3", "zèbra": "zbra-wholesale", "angstrom": "angstrom-wholesale", "Ångström": "ngstrm-wholesale"}


def test_figures_are_kept_or_withdrawn(spark):
    odd = ['{"a": "Over 5", "b": 7, "c": " ", "": "x", "d": null, "e": ["f"], "g": {"h": "i"}}', "[1]", "no json", None, "{}"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k int, v string").orderBy("k")
    assert [r[0] for r in df.select(publication.from_snapshot(F.col("v"))).collect()] == [{"a": "Over 5"}, {}, {}, {}, {}]
    rows = spark.createDataFrame([("x", "k", "new", True, 2), ("x", "k", "later", True, 3), ("x", "k", "first", False, 1), ("x", " ", "v", True, 1), ("x", "gone", "", True, 1), ("x", "j", None, True, 1), ("x", "same", "s", True, 5)], "scope string, key string, value string, publish boolean, ord int")
    read = publication.published(rows)
    assert {tuple(r) for r in read.collect()} == {("x", "k", "new"), ("x", "same", "s")}
    previous = spark.createDataFrame([("x", "k", "old", 1), ("x", "same", "s", 1), ("x", "gone", "g", 1), ("down", "k", "kept", 1), ("quiet", "k", "kept", 1), ("empty", "k", "withdrawn", 1)], "scope string, key string, value string, version int")
    reads = spark.createDataFrame([("x", True, 2), ("down", False, 2), ("empty", True, 2), ("odd", None, 2)], "scope string, ok boolean, version int")
    assert {tuple(r) for r in publication.next_state(previous, read, reads).collect()} == {("x", "k", "new", 2), ("x", "same", "s", 1), ("down", "k", "kept", 1), ("quiet", "k", "kept", 1)}


def test_bodies_of_any_shape(spark):
    bodies = [
        '{"fields": {"email": " A@b.co ", "file": "x", "lines": [{"name": "N", "qty": 2}, {"description": "D", "matched": "M", "price": "3 EUR"}]}}',
        '{"email": "bad", "company_website": "spam", "quotedFile": "big", "lines": "none", "summary": {"lineCount": 4}}',
        "[]", "not json", None,
    ]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string")
    read = intake_payload.composed(df.withColumn("body", intake_payload.parsed(F.col("b"))).withColumn("received", F.lit("2024-01-30 10:00:00").cast("timestamp")))
    got = [(r["ok"], r["error_text"], r["display_name"], r["line_summary"], r["requested_qty"]) for r in read.orderBy("k").collect()]
    none = (False, "no inquiry file received", "Unattributed upload", "No line detail sent with the upload.", "")
    assert got == [
        (True, "", "a@b.co", "- N | qty: 2\n- D | matched: M | 3 EUR", "2"),
        (False, "honeypot triggered; invalid email address; no inquiry file received", "bad", "No line detail sent with the upload.", "4"),
        none, none, none,
    ]
    assert "file" not in json.loads(read.where("k = 0").first()["raw_payload"])
    assert [(r["wanted_id"], r["raw"]) for r in intake_payload.unmatched(read).collect()] == [("W-IQ-20240130-100000-1", "N")]
    many = json.dumps({"results": [{"description": f"d{k}"} for k in range(300)]})
    sent = spark.createDataFrame([(many,)], "r string").select(intake_payload.payload(intake_payload.parsed(F.col("r")), F.try_parse_json(F.lit("{}")), F.try_parse_json(F.lit(None).cast("string")))).first()[0]
    assert len(json.loads(sent)["lines"]) == 200 and json.loads(sent)["fileName"] == "buying-list.xlsx" and "email" not in json.loads(sent)
