"""Trade terms of suppliers' lines: a cascade with sources, notes and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import terms as t

TERMS = ["product_name", "moq_type", "moq_qty", "moq_currency", "moq_source", "mixed_load", "lead_days", "lead_source", "status", "remarks", "unrecognised"]


def with_line_terms(lines: DataFrame, default: Column) -> DataFrame:
    """lines (name, moq, lead, notes, header: text, each may be null) with TERMS; other
    columns stay, a column of one of these names is replaced.

    Cascade: the line's own column, its name, its notes, the list's header, the supplier's
    `default` (as functions.terms.supplier_default gives it). What a line states is never
    overwritten. A quantity without a unit borrows the default's unit and says so. Spans of
    the name that were read as terms are taken out of product_name. status is Clean where
    both minimum and lead time are known and nothing was left over, Unrecognised where
    neither is, else Partial.

    All in place: a line is read where it lies with its header, since a join on the few
    distinct headers would bring most lines to a few tasks.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    wide = lines.withColumns({"_head": t.header_terms(text("header")), "_name": text("name"), "_moq": text("moq"), "_lead": text("lead"), "_notes": text("notes")})
    read = {
        "moq_cell": t.minimum_order(F.col("_moq"), cell=True),
        "moq_name": t.minimum_order(F.col("_name")),
        "moq_notes": t.minimum_order(F.col("_notes")),
        "lead_cell": t.lead_time(F.col("_lead"), cell=True),
        "lead_name": t.lead_time(F.col("_name")),
        "lead_notes": t.lead_time(F.col("_notes")),
        "mixed": t.mixed_load(F.concat_ws("\n", "_name", "_notes", "_moq")),
        "window_name": t.keyword_window(F.col("_name"), rule="keyword"),
        "window_notes": t.keyword_window(F.col("_notes"), rule="keyword"),
        "lead_window_name": t.keyword_window(F.col("_name"), rule="lead"),
        "lead_window_notes": t.keyword_window(F.col("_notes"), rule="lead"),
    }
    wide = wide.withColumn("_default", default).withColumn("_read", F.struct(*(c.alias(k) for k, c in read.items())))
    wide = wide.withColumn("_terms", t.cascade(*map(F.col, ("_name", "_moq", "_notes", "_read", "_head", "_default"))))
    wide = wide.withColumn("product_name", t.cleaned_name(F.col("_name"), F.col("_terms.spans")))
    wide = wide.withColumn("unrecognised", t.unread(*map(F.col, ("_moq", "_lead", "_read", "_terms"))))
    moved = F.when((F.size("_terms.spans") > 0) & (F.col("product_name") != F.col("_name")), F.array(F.lit(t.MOVED))).otherwise(F.array().cast("array<string>"))
    known = F.col("_terms.moq_type").isNotNull().cast("int") + F.col("_terms.lead_days").isNotNull().cast("int")
    status = F.when(known == 0, "Unrecognised").when((known == 2) & (F.size("unrecognised") == 0), "Clean").otherwise("Partial")
    plain = {c: F.col(f"_terms.{c}") for c in ("moq_type", "moq_qty", "moq_currency", "moq_source", "mixed_load", "lead_days", "lead_source")}
    wide = wide.withColumns(plain | {"status": status, "remarks": F.concat("_terms.notes", moved)})
    kept = [c for c in lines.columns if c not in TERMS]
    return wide.select(*kept, *TERMS)
