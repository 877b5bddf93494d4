"""Fail-open reading: a row that cannot be read stays, with an error, and no task fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ERRORS = "array<struct<column:string,value:string>>"


def typed(rows: DataFrame, kinds: dict[str, str], json: dict[str, str] | None = None) -> DataFrame:
    """rows with text columns read as types, and `errors`: (column, value) of what could not be.

    kinds: column -> type, read by try_cast; json: column -> schema, read as JSON objects.
    Null and blank text is a missing value and no error. Nothing raises, whatever the
    session's ANSI setting. A column called errors is replaced; all other columns stay.
    """
    found: list[Column] = []
    out: dict[str, Column] = {}
    for name, kind in kinds.items():
        text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        value = text.try_cast(kind)
        out[name] = value
        found.append(F.when(text.isNotNull() & value.isNull(), _error(name, text)))
    for name, schema in (json or {}).items():
        text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        whole = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        fields = [part.split()[0] for part in schema.split(",")]
        broken = whole["_corrupt"].isNotNull()
        out[name] = F.when(text.isNotNull() & ~broken, F.struct(*(whole[f].alias(f) for f in fields)))
        found.append(F.when(text.isNotNull() & broken, _error(name, text)))
    kept = [c for c in rows.columns if c != "errors"]
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in kept), F.array_compact(F.array(*found)).cast(_ERRORS).alias("errors"))


def _error(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("column"), value.alias("value"))


def good(read: DataFrame) -> DataFrame:
    return read.where(F.size("errors") == 0).drop("errors")


def bad(read: DataFrame) -> DataFrame:
    """The quarantine: rows with an error, their notes, and what of them could be read."""
    return read.where(F.size("errors") > 0).withColumn("note", note())


def note() -> Column:
    """The errors of a row as one line; empty without any."""
    return F.array_join(F.transform("errors", lambda e: F.concat(F.lit("Parser error: "), e["column"], F.lit(" "), e["value"])), " · ")
