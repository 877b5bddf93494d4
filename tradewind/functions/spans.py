"""Matches with their places, and the text around them, as expressions (see sqltext).

A span is a struct with `start` and `end`, in characters from 0, `end` exclusive; other
fields may follow. Everything here is built-in functions over one row's text, so a message
is read where it lies, without a shuffle.
"""

from __future__ import annotations

from tradewind.functions.sqltext import S, Sql, let

_SPAN = "array<struct<start:int,end:int>>"


def found(text: Sql, pattern: str) -> Sql:
    """array<struct<start, end, value>> of a pattern's matches, left to right.

    A text is taken apart behind each match, and the lengths of the parts give the places, by
    a running sum. Null text is null.
    """
    none = S.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(t: Sql, hits: Sql) -> Sql:
        # Not split(), which compiles its pattern for every row.
        parts = S.regexp_extract_all(t, rf"\G(?s:.*?)(?:{pattern})", 0)

        def step(done: Sql, p: Sql) -> Sql:
            end = S.coalesce(S.try_element_at(done, -1)["end"], 0) + S.length(p["part"])
            return S.concat(done, S.array(S.struct((end - S.length(p["value"])).alias("start"), end.alias("end"), p["value"].alias("value"))))

        both = S.zip_with(parts, hits, lambda part, value: S.struct(part.alias("part"), value.alias("value")))
        return S.when(S.size(hits) > 0, S.aggregate(both, none, step)).when(hits.isNotNull(), none)

    return let(text, lambda t: let(S.regexp_extract_all(t, pattern, 0), lambda hits: placed(t, hits)))


def merged(spans: Sql) -> Sql:
    """The union of spans: sorted, without overlaps; spans that touch become one, and empty
    or missing ones go. One fold over the sorted intervals."""
    known = S.filter(spans, lambda s: s["end"] > s["start"])
    ordered = S.array_sort(S.transform(known, lambda s: S.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def step(done: Sql, s: Sql) -> Sql:
        last = S.try_element_at(done, S.lit(-1))
        longer = S.struct(last["start"].alias("start"), S.greatest(last["end"], s["end"]).alias("end"))
        joins = S.coalesce(s["start"] <= last["end"], S.lit(False))
        return S.when(joins, S.concat(S.slice(done, 1, S.size(done) - 1), S.array(longer))).otherwise(S.concat(done, S.array(s)))

    return S.aggregate(ordered, S.array().cast(_SPAN), step)


def gaps(text: Sql, spans: Sql) -> Sql:
    """What of text lies before, between and behind the union of spans: one more than spans."""

    def cut(m: Sql) -> Sql:
        starts = S.concat(S.array(S.lit(0)), m["end"])
        ends = S.concat(m["start"], S.array(S.length(text)))
        return S.zip_with(starts, ends, lambda a, b: S.substring(text, a + 1, S.greatest(b - a, S.lit(0))))

    return let(merged(spans), cut)


def without(text: Sql, spans: Sql, by: str = " ") -> Sql:
    """text with each stretch that spans cover replaced by one `by`."""
    return S.array_join(gaps(text, spans), by)


def tidy(text: Sql) -> Sql:
    """What is left of a name when parts of it were taken out: no empty brackets, no
    punctuation at the edges or after white space, single spaces."""
    out = S.regexp_replace(text, r"\(\s*\)|\[\s*\]", " ")
    out = S.regexp_replace(out, r"[\s,;|]+\z", "")
    out = S.regexp_replace(out, r"[\s\-–—,;|]+\z|\A[\s\-–—,;|]+", "")
    return S.trim(S.regexp_replace(S.regexp_replace(out, r"\s+(?=[,;)])", ""), r"\s{2,}", " "))


def name_without(name: Sql, spans: Sql) -> Sql:
    """A name without the spans that were read as something else; with fewer than three
    characters left, the name as it was."""
    left = tidy(without(name, spans))
    return S.when(S.size(merged(spans)) == 0, name).when(S.length(left) >= 3, left).otherwise(S.trim(name))
