"""Search words of catalogue texts, with sizes in one form: 44cl, 440 ml and 24x440 share 440ml.

A text is read once into lexemes (sizes, percentages, pack counts, numbers, words), and each
lexeme, knowing the one before it, gives its words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.brands import _ACCENTED, _PLAIN
from tradewind.functions.lexicon import table
from tradewind.functions.sqltext import S, Sql, let, on_columns

# Units with their millilitres or grams, words for one thing, words without meaning.
MILLILITRES = {
    "millilitre": 1, "millilitres": 1, "milliliter": 1, "milliliters": 1, "centilitre": 10, "centilitres": 10, "centiliter": 10, "centiliters": 10,
    "litre": 1000, "litres": 1000, "liter": 1000, "liters": 1000, "ltr": 1000, "ltrs": 1000, "ml": 1, "cl": 10, "l": 1000,
}
GRAMS = {"kilogram": 1000, "kilograms": 1000, "kg": 1000, "kgs": 1000, "gram": 1, "grams": 1, "gr": 1, "g": 1, "oz": 28.35}
SYNONYMS = {
    "draft": "draught", "drafts": "draught", "draughts": "draught", "whisky": "whiskey", "whiskies": "whiskey", "whiskeys": "whiskey",
    "liter": "litre", "liters": "litre", "btl": "bottle", "btls": "bottle", "bottles": "bottle", "bt": "bottle", "cans": "can", "tin": "can",
    "tins": "can", "pcs": "piece", "pc": "piece", "pieces": "piece", "ctn": "carton", "ctns": "carton", "cartons": "carton", "cs": "case",
    "cases": "case", "gbx": "giftbox", "gb": "giftbox", "giftbox": "giftbox", "gift": "gift", "pk": "pack", "pks": "pack", "packs": "pack", "ltr": "litre",
}
STOP = ["x", "the", "and", "of", "with", "in", "a", "an", "alc", "abv", "vol", "per", "for"]

_UNITS = "|".join(sorted([*MILLILITRES, *GRAMS], key=len, reverse=True))
_SIZE = rf"[0-9]+(?:[.,][0-9]+)?\s*(?:{_UNITS})(?![a-z0-9_])"
_SHARE = r"[0-9]+(?:\.[0-9]+)?\s*%"
_PACK = r"[0-9]+\s*x\s*(?=[0-9])"
_BARE = r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?(?![0-9.]*\s*(?:ml|g|%|x))(?![a-z0-9_])"
_WORD = rf"[a-z0-9%]+?(?=(?<![0-9])(?:{_SIZE}|{_SHARE})|(?![a-z0-9%]))"
_LEXEME = f"{_SIZE}|{_SHARE}|{_PACK}|{_BARE}|{_WORD}"


def strip_accents(text: Sql) -> Sql:
    """Lower case; letters that are a letter and an accent lose the accent."""
    return S.regexp_replace(S.translate(S.lower(text), _ACCENTED, _PLAIN), "[\\u0300-\\u036f]", "")


def stem(word: Sql) -> Sql:
    """A plural in s or ies of five plain letters or more as its singular."""
    plain = word.rlike("^[a-z]{5,}\\z") & word.rlike("[^suiy]s\\z|ies\\z")
    return S.when(~plain, word).when(S.endswith(word, "ies"), S.concat(S.left(word, S.length(word) - 3), "y")).otherwise(S.left(word, S.length(word) - 1))


def _factor(unit: Sql, units: dict[str, float]) -> Sql:
    return S.try_element_at(table({name: str(n) for name, n in units.items()}), unit).cast("double")


def _words_of(lexeme: Sql, before: Sql) -> Sql:
    """The words of one lexeme. Most are plain words and go no further."""
    whole = lambda x: S.floor(x + 0.5).cast("bigint").cast("string")

    def number(tight: Sql) -> Sql:
        def read(n: Sql) -> Sql:
            value, unit = n["value"], n["unit"]
            bare, decimal = tight.rlike("^[0-9]+(?:\\.[0-9]+)?\\z"), S.contains(tight, ".")
            packed = S.coalesce(before.rlike("^[0-9]+\\s*x"), False)
            litres = bare & decimal & S.when(packed, value < 10).otherwise(tight.rlike("^[0-9]\\.[0-9]{1,2}\\z"))
            sized = lexeme.rlike(f"^{_SIZE}\\z")
            one = S.when(sized & n["ml"].isNotNull(), S.concat(whole(value * n["ml"]), "ml")).when(sized, S.concat(whole(value * _factor(unit, GRAMS)), "g"))
            one = one.when(litres, S.concat(whole(value * 1000), "ml")).when(bare & packed & ~decimal & (value >= 100), S.concat(tight, "ml"))
            return let(one, lambda w: S.when(w.isNotNull(), S.array(w)).otherwise(S.split(tight, "\\.", -1)))

        digits = S.replace(S.regexp_extract(tight, "^[0-9]+(?:[.,][0-9]+)?", 0), ",", ".")
        unit = S.regexp_extract(tight, "[a-z]+\\z", 0)
        return let(S.struct(digits.try_cast("double").alias("value"), unit.alias("unit"), _factor(unit, MILLILITRES).alias("ml")), read)

    return S.when(lexeme.rlike("^[0-9]"), let(S.regexp_replace(lexeme, "\\s+", ""), number)).otherwise(S.split(lexeme, "\\.", -1))


@on_columns
def tokens(text: Sql) -> Sql:
    """The search words of a text, in order; null has none."""
    plain = S.replace(S.regexp_replace(strip_accents(S.coalesce(text, "")), "[’'`]", ""), "×", "x")
    plain = S.regexp_replace(plain, "(?<=[0-9]),(?=[0-9]{3}(?![a-z0-9_]))", "")
    every = let(S.regexp_extract_all(plain, _LEXEME, 0), lambda all_: S.flatten(S.transform(all_, lambda x, k: _words_of(x, S.get(all_, k - 1)))))
    kept = S.filter(every, lambda w: ~w.isin(STOP) & (w != ""))
    return S.filter(S.transform(kept, lambda w: let(S.coalesce(S.try_element_at(table(SYNONYMS), w), w), stem)), lambda w: ~w.isin(STOP))


def normalise(text: Column) -> Column:
    return F.array_join(tokens(text), " ")
