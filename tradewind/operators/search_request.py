"""A search as a query string, planned over an index, barcodes and facets."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qs, quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import brands
from tradewind.operators.search_index import SearchIndex

# The keys of a shared link.
FACET_KEYS = ["cat", "brand", "size", "pack", "bond", "wh", "inco", "moq", "lead"]
SORTS = ["rel", "asc", "desc", "new"]
VIEWS = ["cards", "table"]
PAGE = 48
_CODE = re.compile(r"[0-9]{8,14}")


@dataclass(frozen=True)
class SearchRequest:
    """What a link asks for. Unknown sorts and views are the first of their kind, bounds
    that are no numbers are none, and bounds count only with a currency."""

    q: str = ""
    sort: str = "rel"
    stock: bool = False
    cur: str = ""
    low: float | None = None
    high: float | None = None
    view: str = "cards"
    facets: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def from_query(cls, text: str) -> SearchRequest:
        given = {k: v[0] for k, v in parse_qs(text.lstrip("?"), keep_blank_values=True).items()}
        chosen = {k: [v for v in map(unquote, given.get(k, "").split(",")) if v] for k in FACET_KEYS}
        known = lambda key, kinds: given.get(key) if given.get(key) in kinds else kinds[0]
        return cls(
            given.get("q", "").strip(), known("sort", SORTS), given.get("stock") == "1", given.get("cur", "").upper(),
            _number(given.get("min", "")), _number(given.get("max", "")), known("view", VIEWS), {k: v for k, v in chosen.items() if v},
        )

    def to_query(self) -> str:
        """The link's query string; defaults are left out."""
        parts = [f"q={quote(self.q, safe='')}"] if self.q else []
        parts += [f"{k}={','.join(quote(v, safe='') for v in self.facets[k])}" for k in FACET_KEYS if self.facets.get(k)]
        parts += ["stock=1"] * self.stock + [f"cur={quote(self.cur, safe='')}"] * bool(self.cur)
        parts += [f"{k}={v:g}" for k, v in (("min", self.low), ("max", self.high)) if v is not None]
        parts += [f"sort={self.sort}"] * (self.sort != "rel") + [f"view={self.view}"] * (self.view != "cards")
        return "?" + "&".join(parts) if parts else ""

    def barcodes(self) -> list[str] | None:
        """The barcodes that the text is made of, without leading zeros; None for other text."""
        parts = [p for p in re.split(r"[\s,;]+", self.q) if p]
        return [p.lstrip("0") for p in parts] if parts and all(_CODE.fullmatch(p) for p in parts) else None


def _number(text: str) -> float | None:
    found = re.match(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?", text, re.IGNORECASE)
    value = float(found[0]) if found else math.nan
    return value if math.isfinite(value) else None


def base_rows(docs: DataFrame, index: SearchIndex, request: SearchRequest) -> DataFrame:
    """docs with score and matched that the text asks for: by barcode, by search, or all.

    A text of barcodes alone is an exact lookup; a handful of literals, so the filter
    reaches the scan. Barcodes are in no index: a digit off is another product.
    """
    codes = request.barcodes()
    none = F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched")
    if codes is not None:
        # Stored codes may be padded: the pushed-down test is by length-free keys.
        hit = brands.ean_key(F.col("ean")).isin(codes) | brands.ean_key(F.col("ean_case")).isin(codes)
        return docs.where(F.coalesce(hit, F.lit(False))).select("*", *none)
    if request.q and index.asked(request.q):
        return docs.join(index.search(request.q), index.key)
    return docs.select("*", *none)


def results(docs: DataFrame, index: SearchIndex, facets: list[tuple[str, Column]], price: Column, request: SearchRequest, key: str = "ord") -> DataFrame:
    """Rows that a request shows, with price, score and matched, without order."""
    rows = base_rows(docs, index, request).withColumn("price", price)
    for name, value in facets:
        if request.facets.get(name):
            rows = rows.where(value.isin(request.facets[name]))
    if request.stock:
        rows = rows.where(F.col("stock") == "in")
    if request.cur:
        rows = rows.where(F.col("currency") == request.cur)
        for bound, test in ((request.low, F.col("price") >= F.lit(request.low)), (request.high, F.col("price") <= F.lit(request.high))):
            if bound is not None:
                rows = rows.where(test)
    return rows


def order(request: SearchRequest, key: str = "ord") -> list[Column]:
    """Relevance, price with rows without one last, newest, or featured first."""
    last = F.col(key)
    if request.sort in ("asc", "desc"):
        price = F.col("price").asc() if request.sort == "asc" else F.col("price").desc()
        none = F.col("price").isNull()
        return [none, F.when(~none, F.coalesce("currency", F.lit(""))), price, last]
    if request.sort == "new":
        return [F.coalesce("offer_date", F.lit("")).desc(), last]
    if request.q:
        return [F.desc("matched"), F.desc("score"), last]
    return [F.desc("featured"), last]


def page(rows: DataFrame, request: SearchRequest, size: int = PAGE, key: str = "ord") -> DataFrame:
    """The first `size` rows in the request's order, with `position` from 1: a top-k, whose
    numbering runs over those rows alone."""
    top = rows.orderBy(*order(request, key)).limit(size)
    listed = top.agg(F.collect_list(F.struct(key, "price", "score", "matched")).alias("rows"))
    return listed.select(F.posexplode("rows").alias("at", "r")).select((F.col("at") + 1).alias("position"), "r.*")
