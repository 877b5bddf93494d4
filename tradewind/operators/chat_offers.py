"""Offers and refusals from chat messages, each field with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import messages as m

TERMS = ["incoterm", "warehouse", "bond", "lead", "moq"]
ATTRIBUTES = ["stock_cases", "cases_per_pallet", "pcs_case", "bbd", "ean"]
OFFER = ["line", "mode", "product", "qty", "heading", "price", "reason"]


def offer_lines(messages: DataFrame) -> DataFrame:
    """messages (text, other columns) as one row for each offer or refusal, with OFFER.

    line counts from 0 among the lines that are not empty; mode is list or single; heading
    is the last line above that names a product by its size. Messages without any line
    give no row. All in place: a message is read where it lies, nothing is shuffled.
    """
    return _each(_decided(messages), lambda row, k: F.struct(row.alias("row"))).drop("_text", "_lines", "_rows", "_of")


def _decided(messages: DataFrame) -> DataFrame:
    """messages with their lines and rows, in arrays _lines and _rows."""
    wide = messages.withColumn("_text", m.clean(F.col("text")))
    wide = wide.withColumn("_lines", F.transform(m.lines_of(F.col("_text")), lambda x: m.read_line(x)))
    name = F.when(~m.is_list(F.col("_lines")), m.product_name(F.col("_lines")))
    return wide.withColumn("_rows", m.decided(m.with_headings(F.col("_lines")), name))


def _each(decided: DataFrame, made) -> DataFrame:
    """One row for each of _rows, with OFFER; made(row, number) is a struct `_of` with `row`.

    What is exploded is made here: of a column, Spark would infer a filter, push it below the
    reading of messages, and read them once more for it.
    """
    wide = decided.withColumn("_of", F.explode(F.transform("_rows", made))).withColumn("_row", F.col("_of.row")).withColumn("_bare", m.without_prices(F.col("_row.product")))
    wide = wide.withColumn("_split", m.split_quantity(F.when(F.col("_bare") == "", F.col("_row.product")).otherwise(F.col("_bare"))))
    found = {
        "line": F.col("_row.line"),
        "mode": F.when(F.col("_row.list"), "list").otherwise("single"),
        "product": F.col("_split.name"),
        "qty": F.col("_split.qty"),
        "heading": F.col("_row.heading"),
        "price": F.col("_row.price"),
        "reason": F.col("_row.reason"),
    }
    return wide.withColumns(found).drop("_row", "_bare", "_split")


def chat_offers(messages: DataFrame, defaults: str | None = None) -> DataFrame:
    """offer_lines with TERMS, ATTRIBUTES and, for each term, `<term>_source`.

    A term of the line beats one of the message, which beats the supplier's; `defaults`
    names a struct column with the supplier's terms (null or missing: none). Sources are
    line, message, supplier or the empty string. In a message about one product its whole
    text is the line. Where delivery terms name one place or another, the message has no
    warehouse of its own. Attributes come from the line, or from the whole message of a
    single offer.
    """
    # A message about one product is read once: its own stretch holds all that the message states.
    wide = _decided(messages)
    lists = F.get("_rows", F.lit(0))["list"]
    wide = wide.withColumn("_body", m.body(F.col("_lines"), F.col("_text"))).withColumn("_unsure", F.when(lists, m.several_places(F.col("_text"))))
    wide = wide.withColumn("_scopes", m.scopes(F.col("_rows"), F.col("_lines"), F.col("_body")))
    wide = wide.withColumn("_terms", F.transform(m.stretches(F.col("_rows"), F.col("_lines"), F.col("_scopes"), F.col("_body")), lambda t: m.trade_terms(t)))
    wide = wide.withColumn("_wide", F.when(lists, F.element_at("_terms", -1)))
    rows = _each(wide, lambda row, k: F.struct(row.alias("row"), F.get("_terms", k).alias("terms"), F.get("_scopes", k).alias("scope")))
    rows = rows.withColumn("_own", F.col("_of.terms")).withColumn("_attributes", m.attributes(F.col("qty"), F.col("_of.scope")))
    terms, kinds = {}, {}
    if defaults:
        kinds = {f.name: f for f in rows.schema[defaults].dataType.fields}
    for term in TERMS:
        line, whole = F.col(f"_own.{term}"), F.col(f"_wide.{term}")
        if term == "warehouse":
            whole = F.when(~F.col("_unsure"), whole)
        given = F.nullif(F.col(f"{defaults}.{term}"), F.lit("")) if term in kinds else F.lit(None).cast("string")
        terms[term] = F.coalesce(line, whole, given, F.lit(""))
        terms[f"{term}_source"] = F.when(line.isNotNull(), "line").when(whole.isNotNull(), "message").when(given.isNotNull(), "supplier").otherwise("")
    rows = rows.withColumns(terms | {a: F.col(f"_attributes.{a}") for a in ATTRIBUTES})
    return rows.drop("_text", "_lines", "_rows", "_of", "_body", "_scopes", "_terms", "_own", "_wide", "_unsure", "_attributes")
