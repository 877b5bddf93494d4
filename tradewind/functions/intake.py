"""What a buyer's line asks for: brand, rest, kinds, currency, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.functions.js import blank

#: Words and phrases that name a category, in order of precedence.
CATEGORIES = {
    "Spirits": "whiskey|whisky|bourbon|vodka|gin|rum|tequila|cognac|brandy|liqueur|aperitif|absinthe|mezcal|schnapps|spirit",
    "Champagne": "champagne|prosecco|cava|spumante",
    "Wine": "wine|merlot|shiraz|chardonnay|sauvignon|rioja|bordeaux|rose",
    "Beer": "beer|lager|ale|stout|pilsner|cider",
    "Soft Drinks": "cola|soda|juice|water|energy drink|soft drink|tonic|lemonade",
    "Confectionery": "chocolate|candy|sweets|biscuit|wafer|gum|confection",
    "Toiletries": "shampoo|shower gel|deodorant|toothpaste|soap|lotion|razor|perfume|fragrance|cosmetic",
    "Grocery": "coffee|tea|oil|pasta|rice|sauce|cereal|milk|grocery",
    "Household": "detergent|washing|laundry|softener|capsule|capsules|dishwash|dishwasher|cleaner|bleach|toilet|air freshener|tissue|tissues|kitchen roll|lighter|lighters",
}
#: Units of a quantity, and customs states.
UNITS = {
    "Pallets": "pallet|pallets",
    "Containers": "container|containers|20ft|40ft|fcl",
    "Cases": "case|cases|carton|cartons|cs|ctn|ctns",
    "Bottles": "bottle|bottles|btl|btls",
    "Pieces": "piece|pieces|pc|pcs|unit|units",
}
BONDS = {"T1": "t1", "T2": "t2", "Bonded": "bonded|under bond|in bond", "Duty Paid": "duty paid|duty - paid|dutypaid"}
#: Currencies that can be told, their signs, and words that end a brand.
CURRENCIES = "EUR USD GBP AED SGD".split()
SIGNS = {"€": "EUR", "$": "USD", "£": "GBP"}
PACK_WORDS = "x case cases btl bottle bottles pack pk ctn carton".split()
#: Other names of countries, as letters only.
COUNTRIES = {
    "unitedstates": "usa us unitedstatesofamerica",
    "unitedkingdom": "uk greatbritain england scotland",
    "netherlands": "holland thenetherlands",
    "ireland": "eire irl",
    "czechia": "czechrepublic",
    "russia": "russianfederation",
    "unitedarabemirates": "uae dubai",
    "korea": "southkorea republicofkorea",
}
#: Categories that have a house minimum, and what it says.
MINIMA = {
    "EUR 5,000 minimum order": ["Spirits"],
    "EUR 15,000 minimum order": ["Champagne"],
    "EUR 10,000 minimum order": ["Grocery", "Confectionery", "Toiletries", "Other FMCG", "Household"],
    "Full truck load (FTL)": ["Beer", "Wine", "Soft Drinks"],
}


def first_kind(text: Column, kinds: dict[str, str]) -> Column:
    """The first kind one of whose phrases the text says in whole words, or empty."""
    said = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+|[^a-z0-9_\\s]"), F.lit(0))
    spaced = F.concat(F.lit(" "), F.array_join(said, " "), F.lit(" "))

    def read(line: Column) -> Column:
        return F.coalesce(*(F.when(line.rlike(f" (?:{phrases}) "), kind) for kind, phrases in kinds.items()), F.lit(""))

    # The words are told once for all kinds.
    return F.get(F.transform(F.array(spaced), read), F.lit(0))


def brand_of(text: Column) -> Column:
    """At most four words before the first that holds a digit or speaks of packs."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "(),;|", "     "), "\\s+"), lambda w: w != "")
    ends = F.transform(words, lambda w: w.rlike("[0-9]") | F.lower(w).isin(PACK_WORDS))
    before = F.nullif(F.array_position(ends, True), F.lit(0)) - 1
    return F.array_join(F.slice(words, F.lit(1), F.least(F.coalesce(before, F.lit(4)), F.lit(4)).cast("int")), " ")


def variant_of(text: Column, brand: Column, longest: int = 120) -> Column:
    """What follows the brand's characters, without leading marks."""
    rest = F.trim(F.substr(F.coalesce(text, F.lit("")), F.length(brand) + 1))
    return F.left(F.regexp_replace(rest, "^[-–·,:]+\\s*", ""), F.lit(longest))


def currency_of(text: Column, fallback: Column) -> Column:
    """A code in the text, a sign in it, else the fallback, "Other" where that is unknown."""
    said, other = F.coalesce(text, F.lit("")), F.upper(F.coalesce(fallback, F.lit("")))
    codes = [F.when(F.contains(F.upper(said), F.lit(c)), c) for c in CURRENCIES]
    signs = [F.when(F.contains(said, F.lit(sign)), c) for sign, c in SIGNS.items()]
    return F.coalesce(*codes, *signs, F.when(other.isin(CURRENCIES), other), F.when(other != "", "Other"), F.lit(""))


def positive_number(text: Column) -> Column:
    """The number that a text's digits, points and signs make, null unless positive."""
    n = F.regexp_replace(text, "[^0-9.-]", "").try_cast("double")
    return F.when(n > 0, n)


def country_key(name: Column) -> Column:
    letters = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]", "")
    known = [F.when(letters.isin(others.split()), key) for key, others in COUNTRIES.items()]
    return F.coalesce(*known, letters)


def client_name(cached: Column, links: Column, notes: Column) -> Column:
    """The cached name, else linked names that are no record ids, else the noted buyer."""
    names = F.filter(F.transform(links, lambda n: F.trim(n)), lambda n: (n != "") & ~n.rlike("^rec[A-Za-z0-9]{14}\\z"))
    noted = F.filter(F.split(F.coalesce(notes, F.lit("")), "\\r?\n"), lambda line: line.startswith("Buyer:"))
    stamped = F.trim(F.substr(F.get(noted, F.lit(0)), F.lit(7)))
    return F.coalesce(blank(F.trim(cached)), blank(F.array_join(names, ", ")), F.when(F.lower(stamped) != "unattributed", stamped), F.lit(""))


def house_minimum(category: Column) -> Column:
    """What the house asks at least in a category, null where it says nothing."""
    return F.coalesce(*(F.when(F.trim(category).isin(names), text) for text, names in MINIMA.items()))
