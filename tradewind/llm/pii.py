"""Personal data: exact patterns, and identifiers found by bootstrapped contexts.

All of it is DataFrame and SQL functions. Base matches of four kinds seed the method.
So do tokens in the shape of a key: twenty or more letters and digits, both among them.
Around each token that could be an identifier stand two lexical patterns, what precedes
it and what follows it. Patterns and instances form a graph: a pattern is as good as its
instances, an instance half as good as its best pattern. Scores are passed over the graph
until they settle; patterns with high scores then mark identifiers that no base pattern
and no shape describes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import staged

# The contract's patterns. \\G and the look-behinds only fix where a leftmost match can
# begin, and possessive quantifiers where none can be given back: the same matches, found
# in linear time and without recursion on very long runs.
KINDS: list[tuple[str, str]] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: Kind of the spans that contexts add.
FOUND = "identifier"
#: The least score of a pattern that may mark identifiers, the least number of distinct
#: instances that support it, what an instance takes from its best pattern, and the change
#: below which scores have settled: each pass at least halves it.
CONFIDENT, SUPPORT, PASSED, SETTLED = 0.6, 3, 0.5, 0.01
#: The shape of a key.
_KEY = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+\z"

#: A token with a digit or an at sign; its outer punctuation is then taken off. Base matches
#: (masked as \u0001) end a token like white space, so no token reaches into one.
_TOKEN = r"(?<![^\s\u0001])[^\s0-9@\u0001]*+[0-9@][^\s\u0001]*+"
_LEADING, _TRAILING = r"^[^A-Za-z0-9@+]++", r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++\z"
#: Words of context on each side, of which at most two make a pattern.
_AROUND = 4

_SPAN = "struct<start:long,end:long,value:string,left:string,right:string>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nearest(piece: Column, words: int) -> Column:
    """The first words of a piece between two matches, or the last if words is negative."""
    return F.substring_index(F.translate(piece, "\n\r\t", "   "), " ", words)


_CHUNK = 64


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, value, left, right>> of all matches, in code points.

    The pieces between the matches give the offsets by one running sum, and the contexts.
    Spans are gathered by the _CHUNK, so that a text with many costs no square of them. A
    text without `needs` is not scanned.
    """

    def scan(pieces: Column) -> Column:
        found, between = pieces["found"], pieces["between"]
        sized = F.zip_with(between, found, lambda b, f: F.struct(b.alias("b"), f.alias("f")))
        none, full = F.array().cast(f"array<{_SPAN}>"), F.array().cast(f"array<array<{_SPAN}>>")
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), none.alias("part"), full.alias("parts"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["b"])
            end = start + F.coalesce(F.length(pair["f"]), F.lit(0))
            after = _nearest(F.coalesce(F.get(between, acc["n"] + 1), F.lit("")), _AROUND)
            span = F.struct(start.alias("start"), end.alias("end"), pair["f"].alias("value"), _nearest(pair["b"], -_AROUND).alias("left"), after.alias("right"))
            more = F.concat(acc["part"], F.array(span.cast(_SPAN)))
            fills = F.size(acc["part"]) == _CHUNK - 1
            return F.struct(
                end.cast("long").alias("at"),
                (acc["n"] + 1).alias("n"),
                F.when(fills, none).otherwise(more).alias("part"),
                F.when(fills, F.concat(acc["parts"], F.array(more))).otherwise(acc["parts"]).alias("parts"),
            )

        return F.aggregate(F.filter(sized, lambda p: p["f"].isNotNull()), zero, step, lambda acc: F.concat(F.flatten(acc["parts"]), acc["part"]))

    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(needs), _let(pieces, scan)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _replaced(text: Column, pattern: str, needs: str, by) -> Column:
    """text with by(match) for each match."""

    def join(pieces: Column) -> Column:
        return F.array_join(F.zip_with(pieces["between"], pieces["found"], lambda b, f: F.concat(b, F.when(f.isNull(), "").otherwise(by(f)))), "")

    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(needs), _let(pieces, join)).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits; digits are few, having passed the length test."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|\z)){4}\z")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def _keeps(kind: str):
    return lambda s: _valid(kind, s["value"])


def _swaps(kind: str, by):
    return lambda f: F.when(_valid(kind, f), by(f)).otherwise(f)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with an array column of spans for each base kind, and `candidates`: tokens that
    could be identifiers and lie in no base match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out, masked = docs, text
    for kind, pattern in KINDS:
        out = out.withColumn(kind, F.filter(_matches(text, pattern, _NEEDS[kind]), _keeps(kind)))
        masked = _replaced(masked, pattern, _NEEDS[kind], _swaps(kind, lambda f: F.regexp_replace(f, "(?s).", "\u0001")))
    out = out.withColumn("_masked", masked)

    def core(s: Column) -> Column:
        head = F.regexp_replace(s["value"], _LEADING, "")
        value = F.regexp_replace(head, _TRAILING, "")
        start = s["start"] + F.length(s["value"]) - F.length(head)
        left = F.concat(s["left"], F.left(s["value"], F.length(s["value"]) - F.length(head)))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), left.alias("left"), s["right"].alias("right")).cast(_SPAN)

    tokens = F.transform(_matches(F.col("_masked"), _TOKEN, "[0-9@]"), core)
    fits = F.filter(tokens, lambda s: s["value"].rlike("[0-9@]"))
    return out.withColumn("candidates", fits).drop("_masked")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of one context: two words before, and one on either side."""
    words = F.filter(F.split(F.lower(F.regexp_replace(left, "[0-9]", "#")), r"[\s\"'(\[]+"), lambda w: w != "")
    one, two = F.element_at(F.slice(words, -1, 1), 1), F.slice(words, -2, 2)
    after = F.get(F.filter(F.split(F.lower(F.regexp_replace(right, "[0-9]", "#")), r"[\s\"')\]]+"), lambda w: w != ""), F.lit(0))
    return F.array_compact(F.array(F.when(F.size(words) >= 2, F.concat(F.lit("2:"), F.array_join(two, " "))), F.concat(F.lit("1:"), F.get(F.slice(words, -1, 1), F.lit(0)), F.lit(" _ "), after)))


def _confident(seen: DataFrame) -> DataFrame:
    """Patterns that may mark identifiers, from (pattern, instance, seed).

    Scores are whole millionths, so that sums do not depend on their order. A pattern's
    score is the mean of its instances' scores, an instance's PASSED times the greatest of
    its patterns'; seeds stay at one. Patterns and instances are written before they are
    joined to the graph, so that a common one can be split.
    """
    edges = seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
    edges = staged(edges.join(staged(wide, "wide"), "pattern"), "edges")
    one = 1_000_000
    held = edges.withColumn("score", F.when(F.col("seed"), one).otherwise(0).cast("long"))
    while True:
        patterns = staged(held.groupBy("pattern").agg((F.sum("score") / F.max("support")).cast("long").alias("worth")), "patterns")
        best = edges.where("NOT seed").join(patterns, "pattern").groupBy("instance").agg(F.max("worth").alias("worth"))
        fresh = held.join(staged(best, "best"), "instance", "left")
        fresh = fresh.withColumn("fresh", F.when(F.col("seed"), one).otherwise(F.coalesce("worth", F.lit(0)) * PASSED).cast("long")).drop("worth")
        fresh = staged(fresh, "scores")
        moved = fresh.agg(F.max(F.abs(F.col("fresh") - F.col("score")))).first()[0]
        if (moved or 0) <= SETTLED * one:
            return patterns.where(F.col("worth") >= int(CONFIDENT * one)).select("pattern")
        held = fresh.drop("score").withColumnRenamed("fresh", "score")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, and arrays of spans (start, end in code points, end exclusive):
    email, ip, card, phone, identifier. One row for each row of docs.

    Null texts are empty and have no spans. Rows with equal texts get equal spans, whatever
    their ids; ids may be null or repeated. Empty input gives no rows. Identifiers never
    lie inside a base match. Other columns of docs are not read.
    """
    kinds = [kind for kind, _ in KINDS]
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    base = staged(base_spans(plain).select("doc_id", "text_key", *kinds, "candidates"), "base")
    seeds = base.select(F.explode(F.concat(*kinds)).alias("s"), F.lit(True).alias("seed"), F.lit(None).cast("binary").alias("text_key"))
    tokens = base.select(F.explode("candidates").alias("s"), "text_key").select("s", F.col("s.value").rlike(_KEY).alias("seed"), "text_key")
    seen = seeds.unionByName(tokens).select(F.explode(_patterns(F.col("s.left"), F.col("s.right"))).alias("pattern"), F.lower("s.value").alias("instance"), "seed")
    patterns = staged(_confident(seen), "confident")
    marks = tokens.select("text_key", F.struct("s.start", "s.end", "s.value").alias("span"), F.explode(_patterns(F.col("s.left"), F.col("s.right"))).alias("pattern"))
    marks = marks.join(patterns, "pattern").groupBy("text_key").agg(F.array_sort(F.collect_set("span")).alias(FOUND))
    short = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias(k) for k in kinds]
    none = F.array().cast("array<struct<start:long,end:long,value:string>>")
    return base.select("doc_id", "text_key", *short).join(marks, "text_key", "left").withColumn(FOUND, F.coalesce(FOUND, none))


def _written(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    kinds = [kind for kind, _ in KINDS]

    def written(names: list[str]) -> Column:
        each = [_written(k) for k in names]
        return F.array_join(F.concat(*each), ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written(kinds).cast("binary"), 256).alias("base_sha256"), written([*kinds, FOUND]).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; all columns stay.

    Identifiers go first, by their places; base kinds then by their patterns.
    """
    found = find_pii(docs).select("text_key", FOUND).where(F.size(FOUND) > 0).dropDuplicates(["text_key"])
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    joined = keyed.join(found.select(F.col("text_key").alias("_key"), F.col(FOUND).alias("_found")), "_key", "left")
    text = F.col("text")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.lit(f"[{FOUND.upper()}]")).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))

    clean = F.when(F.size("_found") > 0, F.aggregate("_found", zero, step, finish)).otherwise(text)
    for kind, pattern in KINDS:
        joined = joined.withColumn("text", clean)
        clean = _replaced(F.col("text"), pattern, _NEEDS[kind], _swaps(kind, lambda f, name=f"[{kind.upper()}]": F.lit(name)))
    return joined.withColumn("text", clean).select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
