"""Allow-list and content guards that run before anything is published."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a public row.
PUBLIC_KEYS = "id name variants brand category spec currency amount unitAmount priceDetail priceBasis stock qty terms tier origin featured volumeMl pack unitType ean eanCase warehouse incoterm mixedLoad moqLabel moqBucket leadLabel leadBucket note offerDate slug".split()

# Field names that are never public, and words that no public name holds.
FORBIDDEN_FIELDS = [
    "Offer Name", "Notes", "Trader Comment", "Delivery Info Source", "Delivery Notes", "Supplier", "Supplier Name", "Supplier Email", "Supplier Country",
    "Supplier Trust Level", "Supplier Payment Terms", "Buy Price", "Margin %", "Source Sheet", "Source Message ID", "Bundle ID", "Bundle Title", "Target Countries",
    "Excluded Countries", "Target Capsule Tags", "Target Region", "Trust Level", "Best Comparable Price", "Price Delta %", "Price Level", "Client Feedback",
    "WA Broadcast Log", "WA Target Segments", "Numeric Value", "Detail", "Lines Counted", "Lines Skipped No Qty", "Rate Date", "Updated At",
]
FORBIDDEN_PARTS = [
    "supplier", "buy", "cost", "markup", "margin", "trader", "vendor", "contact", "internal", "source", "bundle", "target", "excluded", "trust", "comparable", "feedback",
    "broadcast", "purchase", "landed", "comment", "remark", "message", "whatsapp", "email", "phone", "password", "token",
]
FORBIDDEN_WORDS = ["note", "notes", "wa"]
FORBIDDEN_PAIRS = [("payment", "terms"), ("created", "by")]
#: Public names that a forbidden part or word would catch, with the one column each may stand for.
EXCEPTIONS = {"Public Note": "public_note", "note": "note", "MOQ Source": "moq_source"}


def column_name(field: str) -> str:
    """A field's column: & and %, / spelled out, the rest lower case with underscores."""
    text = field.replace("&", "and").replace("%", "pct").replace("/", "_").lower()
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", text)).strip("_")


def is_forbidden(name: str, column: str | None = None) -> bool:
    """Whether a field must not be published: its exact name first, then the exceptions,
    each bound to its own column, then what names may not hold."""
    if name in FORBIDDEN_FIELDS:
        return True
    if name in EXCEPTIONS:
        return column is not None and column != EXCEPTIONS[name]
    plain = column_name(name)
    words = plain.split("_")
    pairs = list(zip(words, words[1:]))
    return any(p in plain for p in FORBIDDEN_PARTS) or any(w in words for w in FORBIDDEN_WORDS) or any(p in pairs for p in FORBIDDEN_PAIRS)


def forbidden(names: list[str], exceptions: frozenset[str] = frozenset()) -> list[str]:
    """The names that must not be published, but for exact exceptions."""
    return [n for n in names if n not in exceptions and is_forbidden(n)]


def check_equal(left: set[str], right: set[str]) -> None:
    """Raise if two allow-lists differ in either direction."""
    if left != right:
        raise ValueError(f"missing {sorted(right - left)}, extra {sorted(left - right)}")


def check_public(df: DataFrame, allowed: list[str] = PUBLIC_KEYS) -> DataFrame:
    """df, if all its columns are allowed and none is forbidden."""
    extra = sorted(set(df.columns) - set(allowed)) + forbidden(df.columns)
    if extra:
        raise ValueError(f"columns that are not public: {extra}")
    return df


def leaks(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose JSON form matches a forbidden pattern."""
    text = F.to_json(F.struct(*df.columns))
    return df.where(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def shrunk(before: int, after: int, floor: float = 0.8) -> bool:
    """Whether a snapshot lost so many rows that it must not replace the last one."""
    return after < floor * before
