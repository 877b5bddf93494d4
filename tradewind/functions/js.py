"""Small builders that keep the catalogue's number and text conventions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(x + 0.5)


def blank(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(100 * part / whole + 0.5)).cast("long")


def trimmed_number(x: Column) -> Column:
    """At most two decimals, without trailing zeros."""
    text = F.format_string("%.2f", x)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


def numbered(window: WindowSpec) -> Column:
    """Row numbers from 1."""
    return F.row_number().over(window).cast("long")
