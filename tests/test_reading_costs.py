"""Reading texts costs what their length tells, and is dealt over all cores."""

import re

import pytest
from pyspark.sql import functions as F

from tradewind.functions import intake, messages
from tradewind.functions.sqltext import applied
from tradewind.operators import intake_payload
from tradewind.operators.chat_offers import chat_offers
from tradewind.operators.terms import with_line_terms
from tradewind.sources import adapters

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["messages", "term_lines", "enquiry_lines", "service_results"])
def test_texts_are_dealt_over_all_cores(spark, name):
    rows = adapters.view(spark, DATA, name)
    assert adapters.table(spark, DATA, "part").rdd.getNumPartitions() == 1
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_letters_equal_a_scan(spark):
    texts = ["EUR 5.50/btl, 1,250 cs", " \t3x70cl\n\nNescafé €2 ", "\u212aG \u0130x \u00dft", "a\x01b \U0001f600 \u0300z", "\u2003x\u00a0y", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    words = messages.WORDS
    got = [r[0] for r in rows.select(applied(words.tokens, F.col("t"))).collect()]
    for text, read in zip(texts, got):
        if text is None:
            assert read.values is None and read.kinds is None
            continue
        letter = r"[^\W\d_]"  # as Java's letters in these texts
        values = re.findall(rf"[0-9]+(?:[.,][0-9]+)*|{letter}+|\n|(?![ \t\n\x0b\f\r0-9]|{letter}).", text, re.S)
        shape = lambda v: words.plain_number if v[0].isdigit() else words.plain_word if v[0].isalpha() else words.other
        assert read.values == values
        assert read.kinds == "".join(words.letter_of.get(v.lower(), shape(v)) for v in values)


def test_hits_have_places_in_the_text(spark):
    words, text = messages.WORDS, "  Gin 70cl\n @ EUR 5.50 /btl | 7 €  "
    rows = spark.createDataFrame([(text,), ("no such thing",), (None,)], "t string")
    got = [r[0] for r in rows.select(applied(lambda t: words.hits(words.tokens(t), messages._RULES["price"]), F.col("t"))).collect()]
    assert [text[h.start : h.end] for h in got[0]] == ["EUR 5.50 /btl", "7 €"] and [h.first for h in got[0]] == [5, 10]
    assert got[1:] == [[], None]


def test_a_line_is_told_once_for_all_kinds(spark):
    df = spark.createDataFrame([("Old Gin, 6 x 70cl duty-paid",)], "t string").select(intake.first_kind(F.col("t"), intake.CATEGORIES).alias("kind"))
    assert df.first()[0] == "Spirits" and plan(df).count("regexp_extract_all") == 1


def test_a_body_is_parsed_once(spark):
    df = spark.createDataFrame([('{"fields": {"a": 1}}',), ('{"a": 2}',), ("[",)], "t string").select(F.to_json(intake_payload.parsed(F.col("t"))).alias("body"))
    assert [r[0] for r in df.collect()] == ['{"a":1}', '{"a":2}', None] and plan(df).count("parseJson") == 1


def test_terms_of_lines_need_no_join(spark):
    default = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("qty"), F.lit(None).cast("int").alias("days"))
    lines = spark.createDataFrame([("Old Gin", None, None, None, "Lead time 5 days")], "name string, moq string, lead string, notes string, header string")
    read = with_line_terms(lines, default)
    assert "Join" not in plan(read) and read.first().lead_days == 5


def test_terms_of_offers_are_read_from_the_letters_of_lines(spark):
    df = chat_offers(spark.createDataFrame([("A 70cl EUR 1",)], "text string"))
    # Each ascii() tells the tokens of some text: whole messages and scopes are not told anew.
    assert plan(df).count("ascii(") < 60 and "Filter" not in plan(df)


def test_a_price_without_a_currency_leaves_the_name(spark):
    (r,) = chat_offers(spark.createDataFrame([("\n Gin 70cl 5/btl\n\n 12 cs  \n EXW Riga or NL",)], "text string")).collect()
    assert (r["product"], r["price"], r["stock_cases"], r["incoterm"], r["warehouse"], r["warehouse_source"]) == ("Gin 70cl", "5/btl", 12, "EXW", "NL", "line")


def test_letters_know_a_capital_that_grows(spark):
    words = messages.WORDS
    df = spark.createDataFrame([("İn EUR Σİ 5 xİ",)], "t string").select(applied(words.letters, F.col("t")))
    assert df.first()[0] == words.plain_word + words.letter_of["eur"] + words.plain_word + words.plain_number + words.plain_word
