"""Enquiries as semi-structured rows: what a pricing service says, as payloads, lines and checks.

Bodies are JSON of any shape. They are parsed once into VARIANT, which keeps every key; a
missing key, a null and a value of the wrong kind all read as null, and nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that a payload carries and a summary lists; the receiver takes no more.
MOST_LINES = 200
#: Characters of a file in base64 that the receiver stores.
MOST_FILE = 5 * 1024 * 1024

LINE = ["description", "sourceRow", "qty", "unit", "matched", "brand", "volumeMl", "needsReview", "matchMethod", "price", "target", "note"]


def parsed(body: Column) -> Column:
    """JSON text as VARIANT; null if it is none. A body wrapped as {"fields": {...}} is
    unwrapped, a bare one stays."""

    def unwrapped(whole: Column) -> Column:
        inner = F.try_variant_get(whole, "$.fields", "variant")
        return F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(whole)

    return F.get(F.transform(F.array(F.try_parse_json(body)), unwrapped), F.lit(0))


def text(body: Column, path: str) -> Column:
    return F.trim(F.try_variant_get(body, f"$.{path}", "string"))


def _filled(body: Column, path: str) -> Column:
    return F.nullif(text(body, path), F.lit(""))


def _number(body: Column, *paths: str) -> Column:
    """The first path that holds a finite number, also as text."""
    each = [F.try_variant_get(body, f"$.{p}", "string").try_cast("double") for p in paths]
    return F.coalesce(*(F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n) for n in each))


def _plain(n: Column) -> Column:
    """A number as people write it: no decimals where there are none."""
    return F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise(n.cast("string"))


def line(row: Column) -> Column:
    """struct of LINE for one result row. What is not known is null, so that JSON leaves the
    key out; `matched` is absent where nothing could be sold, and that absence is the signal."""
    match = F.try_variant_get(row, "$.match", "variant")
    has = F.schema_of_variant(match).startswith("OBJECT")
    name = F.concat_ws(" ", *(_filled(match, k) for k in ("brand", "productName", "variant")))
    price, basis = _number(row, "wholesalePrice"), F.regexp_replace(F.coalesce(text(row, "wholesaleBasis"), F.lit("")), "(?i)^per\\s+", "")
    label = F.concat(F.concat_ws(" ", _plain(price), _filled(row, "wholesaleCurrency")), F.when(basis != "", F.concat(F.lit("/"), basis)).otherwise(""))
    review = F.coalesce(F.try_variant_get(row, "$.needsReview", "boolean"), F.lit(False))
    parts = {
        "description": F.coalesce(_filled(row, "description"), F.lit("(unnamed line)")),
        "sourceRow": F.try_variant_get(row, "$.sourceRow", "bigint"),
        "qty": _number(row, "quantity", "unitsOrdered"),
        "unit": _filled(row, "quantityBasis"),
        "matched": F.when(has, F.when(name == "", "matched").otherwise(name)),
        "brand": F.when(has, _filled(match, "brand")),
        "volumeMl": F.when(has, F.try_variant_get(match, "$.volumeMl", "double")),
        "needsReview": F.when(has & review, F.lit(True)),
        "matchMethod": F.when(has, _filled(match, "matchMethod")),
        "price": F.when(has & price.isNotNull(), label),
        "target": _number(row, "customerPriceBase"),
        "note": _filled(row, "note"),
    }
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def lines(result: Column, most: int = MOST_LINES) -> Column:
    """array of `line` structs of a result's rows, at most `most`; no rows, an empty array."""
    rows = F.coalesce(F.try_variant_get(result, "$.results", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.slice(rows, 1, most), line)


def _held(fields: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def payload(result: Column, contact: Column, upload: Column) -> Column:
    """The webhook's JSON. Keys without a value are left out, at the top and in the summary."""
    count = lambda k: F.try_variant_get(result, f"$.summary.{k}", "double")
    top = {"email": F.lower(_filled(contact, "email"))} | {k: _filled(contact, k) for k in ("name", "company", "phone", "country", "note")}
    top |= {"fileName": F.coalesce(_filled(upload, "name"), F.lit("buying-list.xlsx")), "fileType": F.coalesce(_filled(upload, "type"), F.lit("application/octet-stream")), "file": _filled(upload, "file")}
    summary = {
        "lineCount": count("totalRows"), "matchedCount": count("matchedRows"), "needsReviewCount": count("needsReviewRows"), "total": count("totalWholesaleValue"),
        "currency": _filled(result, "summary.currency"), "buyerTotal": count("totalCustomerValue"), "savingPct": count("savingPct"),
    }
    return F.to_json(_held(top | {"lines": lines(result), "summary": _held(summary)}), {"ignoreNullFields": "true"})


def errors(body: Column) -> Column:
    """Why a body is refused, joined by "; "; empty if it is not. A list that nobody signed
    is still worth keeping: only a file is needed, and an address that is one, if given."""
    email, filled = F.lower(F.coalesce(text(body, "email"), F.lit(""))), lambda k: _filled(body, k).isNotNull()
    return F.concat_ws(
        "; ",
        F.when(filled("company_website"), "honeypot triggered"),
        F.when((email != "") & ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), "invalid email address"),
        F.when(~filled("file"), "no inquiry file received"),
    )


def composed(bodies: DataFrame, body: str = "body", stamp: str = "received") -> DataFrame:
    """bodies (a VARIANT column, and the time of receipt) as enquiries: ok, error_text,
    enquiry_id, display_name, line_summary, requested_qty, too_big, raw_payload (the body
    without its files). Other columns stay."""
    b = F.col(body)
    told = F.coalesce(F.try_variant_get(b, "$.lines", "array<variant>"), F.array().cast("array<variant>"))

    def listed(row: Column) -> Column:
        bits = [F.coalesce(_filled(row, "description"), _filled(row, "name"), F.lit("(unnamed line)")), F.concat(F.lit("matched: "), _filled(row, "matched")), F.concat(F.lit("qty: "), _filled(row, "qty")), _filled(row, "price")]
        return F.concat(F.lit("- "), F.concat_ws(" | ", *bits))

    summary = F.array_join(F.transform(F.slice(told, 1, MOST_LINES), listed), "\n")
    kept = F.map_filter(F.try_variant_get(b, "$", "map<string, variant>"), lambda k, v: ~k.isin("file", "quotedFile"))
    too_big = lambda k: F.coalesce(F.length(text(b, k)) > MOST_FILE, F.lit(False))
    found = {
        "error_text": errors(b),
        "ok": errors(b) == "",
        "enquiry_id": F.concat(F.lit("IQ-"), F.date_format(stamp, "yyyyMMdd-HHmmss")),
        "display_name": F.coalesce(_filled(b, "company"), _filled(b, "name"), F.lower(_filled(b, "email")), F.lit("Unattributed upload")),
        "line_summary": F.when(summary == "", "No line detail sent with the upload.").otherwise(summary),
        "requested_qty": F.coalesce(_filled(b, "summary.lineCount"), F.nullif(F.size(told).cast("string"), F.lit("0")), F.lit("")),
        "too_big": too_big("file") | too_big("quotedFile"),
        "raw_payload": F.to_json(kept),
    }
    return bodies.withColumns(found)


def unmatched(enquiries: DataFrame, body: str = "body") -> DataFrame:
    """One row for each line of an enquiry that nothing was priced against, at most
    MOST_LINES for each: wanted_id, n (from 1), raw, and the enquiry's links, attached to
    every line. Enquiries without such a line give no row."""
    told = F.coalesce(F.try_variant_get(F.col(body), "$.lines", "array<variant>"), F.array().cast("array<variant>"))
    open_lines = F.slice(F.filter(told, lambda r: _filled(r, "matched").isNull()), 1, MOST_LINES)
    each = enquiries.select("*", F.posexplode(open_lines).alias("_n", "_line"))
    raw = F.coalesce(_filled(F.col("_line"), "description"), _filled(F.col("_line"), "name"), F.lit("(unnamed line)"))
    identity = F.concat(F.regexp_replace("enquiry_id", "^IQ-", "W-IQ-"), F.lit("-"), (F.col("_n") + 1).cast("string"))
    return each.select("*", identity.alias("wanted_id"), (F.col("_n") + 1).alias("n"), raw.alias("raw"), _number(F.col("_line"), "target", "targetPrice", "cost").alias("target")).drop("_n", "_line")


def quoted(result: Column) -> Column:
    """array<struct<review, matched, saving>> of a result's rows: what a quote's views ask."""
    rows = F.coalesce(F.try_variant_get(result, "$.results", "array<variant>"), F.array().cast("array<variant>"))

    def said(row: Column) -> Column:
        review = F.coalesce(F.try_variant_get(row, "$.needsReview", "boolean"), F.lit(False))
        matched = F.coalesce(F.schema_of_variant(F.try_variant_get(row, "$.match", "variant")).startswith("OBJECT"), F.lit(False))
        saving = F.coalesce(_number(row, "lineSaving"), _number(row, "customerPriceBase") - _number(row, "wholesalePrice"))
        return F.struct(review.alias("review"), matched.alias("matched"), saving.alias("saving"))

    return F.transform(rows, said)


def views(lines: DataFrame) -> DataFrame:
    """lines (with a struct `q` of `quoted`) once for each view that they are in: all, review,
    saving and unmatched; `q` becomes saving."""
    named = {"all": F.lit(True), "review": F.col("q.review"), "saving": F.col("q.saving") > 0, "unmatched": ~F.col("q.matched")}
    inside = F.array_compact(F.array(*(F.when(test, name) for name, test in named.items())))
    return lines.select(F.explode(inside).alias("view"), *[c for c in lines.columns if c != "q"], F.col("q.saving").alias("saving"))
