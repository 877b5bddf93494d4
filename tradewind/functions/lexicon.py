"""Small grammars over words, as expressions (see sqltext).

A Lexicon names sets of words, which may overlap. Text is cut into tokens (numbers, words,
single marks); each token gets one letter that stands for the sets it is in. A rule is
written over the names of sets and runs as a pattern over those letters, so it sees words
and not spelling, and every hit has its place in the text and its tokens. The letters of a
text are one string, made once; most rules fail on it, and only hits cost more than that.
"""

from __future__ import annotations

import re

from tradewind.functions.spans import found
from tradewind.functions.sqltext import S, Sql, let

#: Numbers with inner separators, words, line ends and single marks.
_TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+|\n|[^\s\p{L}0-9]"
#: A token and the white space before it: together these are the text, up to its last token.
_PIECE = rf"[^\S\n]*(?:{_TOKEN})"
#: Words are looked up among those whose first character has the same remainder.
_SHELVES = 61
_LETTERS = [chr(k) for k in range(0x61, 0x7B)] + [chr(k) for k in range(0x41, 0x5B)] + [chr(k) for k in range(0xC0, 0x17F) if chr(k).isalpha()]


#: The type of a hit.
HIT = "struct<start:int,end:int,first:int,parts:array<struct<value:string,kind:string>>>"


class Lexicon:
    """Named sets of lower-case tokens. `number`, `word` (a word in no set) and `any` are
    names that every lexicon has; a set may hold numbers too."""

    def __init__(self, **sets: list[str]):
        kinds: dict[str, frozenset[str]] = {}
        for word in {w for words in sets.values() for w in words}:
            kinds[word] = frozenset(name for name, words in sets.items() if word in words)
        groups = sorted(set(kinds.values()), key=sorted)
        number, word, other, *letters = _LETTERS
        letter = dict(zip(groups, letters, strict=False))
        self.other, self.plain_word, self.plain_number = other, word, number
        self.letter_of = {w: letter[k] for w, k in sorted(kinds.items())}
        self.shelves: list[dict[str, str]] = [{} for _ in range(_SHELVES)]
        for w, x in self.letter_of.items():
            self.shelves[ord(w[0]) % _SHELVES][w] = x
        self.classes = {name: "".join(letter[g] for g in groups if name in g) for name in sets}
        self.classes["number"] = number + "".join(sorted({x for w, x in self.letter_of.items() if w[0].isdigit()}))
        self.classes["word"] = word

    def letters(self, text: Sql) -> Sql:
        """The letters of a text's tokens as one string; null for null text."""
        shelves = S.array(*map(table, self.shelves))

        def kind(w: Sql) -> Sql:
            # By comparison where one character tells: a pattern for each token is dear.
            shape = S.when((w >= "a") & (w < "{"), self.plain_word).when((w >= "0") & (w < ":"), self.plain_number)
            shape = shape.when(w < "\u0080", self.other).when(w.rlike(r"^\p{L}"), self.plain_word).otherwise(self.other)
            return S.coalesce(S.try_element_at(S.get(shelves, S.pmod(S.ascii(w), _SHELVES)), w), shape)

        # The text is put in lower case once. Only this capital would become two characters.
        low = S.lower(S.replace(text, "\u0130", "\u0131"))
        return S.array_join(S.transform(S.regexp_extract_all(low, _TOKEN, 0), kind), "")

    def told(self, text: Sql) -> Sql:
        """struct<text, kinds>: a text and its letters, which is what rules run on."""
        return let(text, lambda t: S.struct(t.alias("text"), self.letters(t).alias("kinds")))

    def tokens(self, text: Sql) -> Sql:
        """struct<text, values, kinds>: tokens, and their letters as one string; all null for
        null text."""
        return let(text, lambda t: S.struct(t.alias("text"), values(t).alias("values"), self.letters(t).alias("kinds")))

    def rule(self, text: str) -> str:
        """A rule over names, as a pattern over letters. Operators are those of patterns."""
        named = re.sub(r"[a-z_]+", lambda m: "." if m[0] == "any" else f"[{self.classes[m[0]]}]", text)
        return re.sub(r"\s+", "", named)

    def hits(self, tokens: Sql, rule: str) -> Sql:
        """array<struct<start, end, first, parts>> of a rule: place in the text, number of
        the first token, and the tokens' values and kinds. tokens: `told` of the text."""
        pattern = self.rule(rule)

        def placed(t: Sql, cut: Sql) -> Sql:
            def upto(n: Sql) -> Sql:
                return S.length(S.array_join(S.slice(cut["pieces"], 1, n), ""))

            def one(s: Sql) -> Sql:
                hit = S.slice(cut["values"], s["start"] + 1, s["end"] - s["start"])
                return S.struct(
                    (upto(s["start"] + 1) - S.length(S.get(cut["values"], s["start"]))).alias("start"),
                    upto(s["end"]).alias("end"),
                    s["start"].alias("first"),
                    S.transform(hit, lambda v, k: S.struct(v.alias("value"), S.substring(s["value"], k + 1, 1).alias("kind"))).alias("parts"),
                )

            return S.transform(found(t["kinds"], pattern), one)

        def spans(t: Sql) -> Sql:
            cut = S.struct(S.regexp_extract_all(t["text"], _PIECE, 0).alias("pieces"), values(t["text"]).alias("values"))
            told = let(cut, lambda c: placed(t, c))
            return S.when(t["kinds"].rlike(pattern), told).when(t["kinds"].isNotNull(), S.array().cast(f"array<{HIT}>"))

        return let(tokens, spans)

    def first(self, tokens: Sql, rule: str) -> Sql:
        """The parts of the first hit of a rule without anchors, without places; null if none."""
        pattern = self.rule(rule)

        def read(t: Sql) -> Sql:
            before = S.length(S.regexp_extract(t["kinds"], f"^(.*?)(?:{pattern})", 1))

            def parts(kinds: Sql) -> Sql:
                hit = S.slice(values(t["text"]), before + 1, S.length(kinds))
                return S.transform(hit, lambda v, k: S.struct(v.alias("value"), S.substring(kinds, k + 1, 1).alias("kind")))

            return S.when(t["kinds"].rlike(pattern), let(S.regexp_extract(t["kinds"], pattern, 0), parts))

        return let(tokens, read)

    def says(self, tokens: Sql, rule: str) -> Sql:
        """Whether a rule has a hit."""
        return tokens["kinds"].rlike(self.rule(rule))

    def pick(self, parts: Sql, name: str, nth: int = 0) -> Sql:
        """The value of the nth of the tokens that is in the set; null if none is."""
        return S.get(S.filter(parts, lambda t: S.contains(S.lit(self.classes[name]), t["kind"])), S.lit(nth))["value"]


def values(text: Sql) -> Sql:
    """The tokens of a text."""
    return S.regexp_extract_all(text, _TOKEN, 0)


def table(pairs: dict[str, str]) -> Sql:
    """A constant map, as one literal to plan."""
    return S.str_to_map(S.lit("\u0002".join(f"{k}\u0001{v}" for k, v in pairs.items())), S.lit("\u0002"), S.lit("\u0001"))


def mapped(value: Sql, lists: dict[str, list[str]]) -> Sql:
    """The key under which value, in lower case, is listed."""
    return S.try_element_at(table({word: key for key, words in lists.items() for word in words}), S.lower(value))
