"""Operators without an SQL twin: ordered folds, guards, sources, streams."""

import pytest
from pyspark.sql import functions as F

from tradewind.functions import extraction
from tradewind.operators import guards, slugs
from tradewind.sources import readers
from tradewind.streaming import demand


def test_slug_suffixes_meet_natural_ones(spark):
    rows = spark.createDataFrame(list(enumerate(["x", "x", "x-2", "y", "x", "y-3", "y", "y"])), "ord long, slug string")
    got = [r["unique_slug"] for r in slugs.deduped(rows).orderBy("ord").collect()]
    assert got == ["x", "x-2", "x-2-2", "y", "x-3", "y-3", "y-2", "y-4"]


def test_guards(spark):
    assert guards.column_name("Price Per Unit & Case") == "price_per_unit_and_case"
    assert guards.forbidden(["name", "Supplier Name", "Margin %"]) == ["Supplier Name", "Margin %"]
    with pytest.raises(ValueError):
        guards.check_equal({"a"}, {"a", "b"})
    df = spark.createDataFrame([("1", "postgres://u:p@h/db"), ("2", "fine")], "id string, note string")
    assert guards.check_public(df) is df
    assert [r["id"] for r in guards.leaks(df, ["postgres://"]).collect()] == ["1"]
    with pytest.raises(ValueError):
        guards.check_public(df.withColumnRenamed("note", "cost"))
    assert guards.shrunk(100, 79) and not guards.shrunk(100, 80)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    path = str(tmp_path / "snapshot")
    assert readers.write_if_changed(df, path, "id string, n int")
    assert not readers.write_if_changed(df.orderBy("id"), path, "id string, n int")
    assert readers.write_if_changed(df.where("n > 1"), path, "id string, n int")
    empty = df.where("false")
    assert readers.first_source(lambda: readers.snapshot(spark, "/no/such", "id string"), lambda: empty, lambda: df) is df
    with pytest.raises(ValueError):
        readers.first_source(lambda: empty)


def read_terms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    return [tuple(r) for r in df.orderBy("k").select(extraction.minimum_order(F.col("v"))["type"], extraction.minimum_order(F.col("v"))["qty"], extraction.lead_days(F.col("v")), extraction.mixed_load(F.col("v"))).collect()]


def test_trade_terms(spark):
    got = read_terms(spark, ["MOQ 50 cases", "Minimum order EUR 10k, 2-3 weeks", "no MOQ, ex-stock", "15 min walk", "moq 5-10 pallets | not mixed", "36 hrs", "out of stock", None])
    assert got == [
        ("Cases", 50.0, None, None),
        ("Order Value", 10000.0, 21, None),
        ("No Minimum", None, 0, None),
        (None, None, None, None),
        ("Pallets", 5.0, None, False),
        (None, None, 2, None),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_stream_of_demand(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 3} 10:00:00", k % 2, "View") for k in range(9)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = demand.windowed_demand(stream).writeStream.format("memory").queryName("asks").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["asks"], r["buyers"]) for r in spark.table("asks").where("since = timestamp'2023-12-28'").collect()} == {(9, 2)}
    state = demand.keep_latest(stream.select(F.col("user_id").cast("string").alias("slug"), "ts", "event_id"), str(tmp_path / "state"), str(tmp_path / "cp"))
    state.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "state" / "version=0")).count() == 2


def test_line_sink_and_csv_upload(spark, tmp_path):
    from tradewind.sources import readers

    path = str(tmp_path / "lines")
    readers.write_lines(spark.createDataFrame([("n",), ("1",), ("2",)], "line string").coalesce(1), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ["1", "2", "n"]
    (tmp_path / "up.csv").write_text("id,n\na,1\nb,x\n")
    assert {tuple(r) for r in readers.csv_upload(spark, str(tmp_path / "up.csv"), "id string, n int").collect()} == {("a", 1), ("b", None)}


def test_ranks_are_whole_over_cuts(spark):
    from tradewind.operators.ranks import ranked

    rows = [(k, 3 * n) for k in ("a", "b") for n in range(40)] + [(None, 1), ("a", None), ("c", -5)]
    got = {(r.k, r.o): r.r for r in ranked(spark.createDataFrame(rows, "k string, o long"), "k", "o", "r", bits=3).collect()}
    assert got == {(k, 3 * n): n + 1 for k in ("a", "b") for n in range(40)} | {("c", -5): 1}
    assert ranked(spark.createDataFrame([], "k string, o long"), "k", "o", "r").count() == 0


def test_offers_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    from tradewind.operators.normalisation import PUBLIC, normalised, with_facets

    kinds = dict.fromkeys(["stock_cases", "volume_ml", "pallet_cases", "pallet_pieces", "moq_qty"], "double") | dict.fromkeys(["pcs_case", "lead_time_days"], "int")
    kinds |= dict.fromkeys(["featured", "mixed_load"], "boolean") | {"ord": "long"}
    cases = [
        {},
        {"price_detail": "EUR 60/case (8pk)", "pcs_case": 24, "featured": True},
        {"price_detail": "EUR 60/case", "spec": "no count", "variant": " blue "},
        {"price_display": "about 12", "price_type": "Per Pack", "currency": "USD", "terms": "FOB Quay", "warehouse": "Other"},
    ]
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in PUBLIC) + ", supplier_cost double"
    raw = spark.createDataFrame([tuple({"ord": n, **case}.get(c) for c in PUBLIC) + (9.0,) for n, case in enumerate(cases)], schema)
    out = with_facets(normalised(raw))
    assert "supplier_cost" not in out.columns
    rows = out.orderBy("ord").select("amount", "unit_amount", "currency", "price_basis", "featured", "variants", "incoterm", "warehouse", "category").collect()
    assert [tuple(r) for r in rows] == [
        (None, None, "", "", False, "", "", "", "Other"),
        (60.0, 7.5, "EUR", "case", True, "", "", "", "Other"),
        (60.0, 60.0, "EUR", "case", False, "blue", "", "", "Other"),
        (12.0, 12.0, "USD", "pack", False, "", "FOB", "Quay", "Other"),
    ]
    assert normalised(raw.where(F.lit(False))).count() == 0
