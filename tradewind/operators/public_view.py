"""A view of public columns, generated from an allow-list, and its audit.

Readers get the view and nothing else, so a column that is not listed cannot leak: it is
not there. The audit reads the columns back from the catalog and compares.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.guards import check_equal, is_forbidden

_PLAIN = re.compile(r"[a-z_][a-z0-9_]*")


@dataclass(frozen=True)
class Field:
    """A public field: its name, the column of the view, and what computes it (default: the
    base table's column of that name). Filter fields serve conditions and are no display."""

    name: str
    column: str
    computed: str = ""
    only_filter: bool = False


def checked(fields: list[Field]) -> list[Field]:
    """fields, or an error that names each one which must not be published.

    Wrong are forbidden names (exceptions are bound to their column), columns whose own name
    is forbidden under a public name, columns that are no plain names, and repeats.
    """
    wrong = [f.name for f in fields if not f.only_filter and is_forbidden(f.name, f.column)]
    allowed = {f.column for f in fields if f.name in ("Public Note", "note", "MOQ Source")}
    wrong += [f.column for f in fields if not f.only_filter and f.column not in allowed and is_forbidden(f.column)]
    wrong += [f.column for f in fields if not _PLAIN.fullmatch(f.column)]
    seen = [f.column for f in fields]
    wrong += sorted({c for c in seen if seen.count(c) > 1})
    if wrong:
        raise ValueError(f"fields that cannot be published: {wrong}")
    return fields


def view_sql(view: str, base: str, fields: list[Field], condition: str = "true", temporary: bool = False) -> str:
    """The statement that makes the view; it fails before any view is touched."""
    listed = ",\n".join(f"  {f.computed or f'b.`{f.column}`'} AS `{f.column}`" for f in checked(fields))
    kind = "TEMPORARY VIEW" if temporary else "VIEW"
    return f"CREATE OR REPLACE {kind} {view} AS\nSELECT\n{listed}\nFROM {base} b\nWHERE {condition}"


def create(spark: SparkSession, view: str, base: str, fields: list[Field], condition: str = "true", temporary: bool = False) -> DataFrame:
    """Make the view, check it against the list, and return it."""
    spark.sql(view_sql(view, base, fields, condition, temporary))
    check_equal({f.column for f in fields}, {c.name for c in spark.catalog.listColumns(view)})
    return spark.table(view)


def audit(spark: SparkSession, objects: dict[str, list[Field] | None]) -> DataFrame:
    """(object, column, status) as the catalog has them: public, filter, or not listed.

    objects: tables and views with the fields that readers may see; None: none of them.
    One row for each column, so it is as small as the schema.
    """
    rows = []
    for name, fields in objects.items():
        known = {f.column: "filter" if f.only_filter else "public" for f in fields or []}
        rows += [(name, c.name, known.pop(c.name, "not listed")) for c in spark.catalog.listColumns(name)]
        rows += [(name, column, "missing") for column in known]
    return spark.createDataFrame(rows, "object string, column string, status string")


def privileges(audited: DataFrame) -> DataFrame:
    """For each object the statuses of its columns, each once, in order."""
    return audited.groupBy("object").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.count(F.lit(1)).alias("columns"))
