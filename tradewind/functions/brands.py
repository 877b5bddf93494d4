"""Brand spellings, slugs and barcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are quantities, never brands.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve a an".split()
#: Letters that lose no accent by decomposition.
TRANSLITERATED = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def clean_brand(brand: Column) -> Column:
    text = F.trim(F.coalesce(brand, F.lit("")))
    return F.when(F.lower(text).isin(NUMBER_WORDS), F.lit("")).otherwise(text)


def is_shouting(text: Column) -> Column:
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    return (F.length(letters) > 1) & (letters == F.upper(letters))


def fold_accents(text: Column) -> Column:
    """Lower case, Latin letters without accents; combining marks dropped."""
    out = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), "[\\u0300-\\u036f]", "")
    for letter, plain in TRANSLITERATED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def slug(name: Column, spec: Column | None = None, fold: bool = True) -> Column:
    text = F.trim(F.concat_ws(" ", name, spec if spec is not None else F.lit("")))
    text = fold_accents(text) if fold else F.lower(text)
    for pattern, by in (("[^a-z0-9_\\s-]", ""), ("\\s+", "-"), ("-+", "-"), ("^-+|-+\\z", "")):
        text = F.regexp_replace(text, pattern, by)
    return F.when(F.length(text) > 90, F.regexp_replace(F.left(text, F.lit(90)), "-+\\z", "")).otherwise(text)


def category_slug(category: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(category, F.lit("")))), "\\s+", "-")


def ean_key(code: Column) -> Column:
    """Digits without leading zeros, null if not 8 to 14 digits."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), "\\s", "")
    return F.when(digits.rlike("^[0-9]{8,14}\\z"), F.regexp_replace(digits, "^0+", ""))
