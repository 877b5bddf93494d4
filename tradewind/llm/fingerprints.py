"""Document fingerprints from closed syncmers, in DataFrame functions only.

Tokens are words, numbers and other single characters. A window of four tokens is an
anchor if the least of the hashes of its three inner pairs is the first or the last: what
the window itself holds decides, so an edit elsewhere moves no anchor. Two windows of three
are anchors, so a text of a line or two has several, and a sentence that stays shows. A
fingerprint is all anchors whose hash is in the lowest sixteenth of its range, and at least
the 32 lowest, each with its token place: it grows with the text. Two fingerprints match where hashes
agree and places differ by one common shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tradewind.llm.common import staged

#: Tokens of a window, least anchors of a fingerprint (all, if a text has fewer), and how far
#: from the common shift the places of two equal anchors may lie.
WINDOW, ANCHORS, SLACK = 4, 32, 16
#: Anchors with a lower hash are all kept: a sixteenth of them.
LOW = -(1 << 63) + (1 << 60)
#: A word of an alphabetic script, a number, or one character. Where letters run on beyond
#: any word, and in scripts without spaces, each character is a token: what it is decides
#: where tokens begin, never a count from the start.
_LETTERS = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsArabic}\p{IsHebrew}\p{IsHangul}\p{M}]"
_TOKEN = rf"(?<!{_LETTERS}){_LETTERS}{{1,24}}+(?!{_LETTERS})|(?<![0-9])[0-9]{{1,24}}+(?![0-9])|\S"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column) -> Column:
    """array<struct<hash, place>>, by hash: the anchors of text (not null) with a hash below
    LOW, and the ANCHORS lowest in any case. Of equal anchors the first place counts.

    A text without a window or an anchor has itself as only anchor; the empty text none.
    """
    last = WINDOW - 2  # the last inner pair

    def pairs(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))

    def chosen(g: Column) -> Column:
        places = F.when(F.size(g) > last, F.sequence(F.lit(0), F.size(g) - last - 1)).otherwise(F.array().cast("array<int>"))
        edge = lambda i: F.least(F.get(g, i), F.get(g, i + last))
        starts = F.filter(places, lambda i: edge(i) == F.least(*[F.get(g, i + j) for j in range(last + 1)]))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(g, i + j) for j in range(0, last + 1, 2)]).alias("hash"), i.alias("place")))

    def least(found: Column) -> Column:
        first = F.filter(found, lambda x, i: (i == 0) | (x["hash"] != F.get(found, i - 1)["hash"]))
        return _let(first, lambda f: F.filter(f, lambda x, i: (i < ANCHORS) | (x["hash"] < LOW)))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    found = _let(F.sort_array(_let(_let(hashes, pairs), chosen)), least)
    whole = F.array(F.struct(F.xxhash64(text).alias("hash"), F.lit(0).alias("place")))
    none = F.array().cast("array<struct<hash:bigint,place:int>>")
    return F.when(text == "", none).otherwise(_let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole)))


def _complete(found: Column) -> Column:
    """The hash up to which a fingerprint has every anchor of its text."""
    last = F.element_at(found, -1)["hash"]
    return F.when(F.size(found) < ANCHORS, F.lit((1 << 63) - 1)).otherwise(F.greatest(last, F.lit(LOW)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of anchors that two fingerprints have at one shift, among hashes up
    to which both are complete.

    1 for equal fingerprints (two empty ones too), 0 if they have no anchor in common. The
    work is that of sorting both.
    """

    def sided(found: Column, most: Column, side: int) -> Column:
        low = F.filter(found, lambda x: x["hash"] <= most)
        return F.transform(low, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["place"].alias("place")))

    def matched(shifts: Column) -> Column:
        middle = F.get(shifts, F.floor(F.size(shifts) / 2).cast("int"))
        return F.size(F.filter(shifts, lambda x: F.abs(x - middle) <= SLACK))

    def share(both: Column) -> Column:
        after = lambda i: F.get(both, i + 1)
        shifts = F.transform(both, lambda x, i: F.when(x["hash"] == after(i)["hash"], after(i)["place"] - x["place"]))
        return _let(_let(F.sort_array(F.filter(shifts, lambda x: x.isNotNull())), matched), lambda m: 2.0 * m / F.size(both))

    most = F.least(_complete(a), _complete(b))
    both = F.sort_array(F.concat(sided(a, most, 0), sided(b, most, 1)))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(none, F.lit(0.0)).otherwise(_let(both, share))


def written(found: Column) -> Column:
    """The fingerprint as text: hash in hex and place of each anchor."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.lower(F.hex(x["hash"])), x["place"].cast("string"))), " ")


def _following(rows: DataFrame) -> DataFrame:
    """(row_key, n, next_key): each row's successor by descending doc_id (null ids last,
    equal ids by key); after the last comes the first."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("row_key")]
    ranged = rows.select("doc_id", "row_key", "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = staged(ranged.select("row_key", "n", F.monotonically_increasing_id().alias("_place")), "order")
    part = F.shiftright("_place", 33)
    held = ranged.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row for each partition
    starts, total = [], 0
    for at, count in held:
        starts.append((at, total - (at << 33)))
        total += count
    starts = spark.createDataFrame(starts, StructType([StructField("_part", LongType()), StructField("_shift", LongType())]))
    numbered = ranged.join(F.broadcast(starts), part == F.col("_part")).select("row_key", "n", (F.col("_place") + F.col("_shift")).alias("_at"))
    after = numbered.select(F.col("row_key").alias("next_key"), F.pmod(F.col("_at") - 1, F.lit(max(total, 1))).alias("_at"))
    return staged(numbered.join(after, "_at").drop("_at"), "following")


def edited_texts(keyed: DataFrame, following: DataFrame) -> DataFrame:
    """(row_key, edited): the last half of each text replaced by the next one's beginning."""
    half = F.floor(F.col("n") / 2).cast("int")
    heads = keyed.select(F.col("row_key").alias("next_key"), "text").join(following, "next_key")
    heads = heads.select("row_key", "n", F.left("text", half).alias("_head"))
    joined = keyed.select("row_key", "text").join(heads, "row_key")
    return joined.select("row_key", F.concat(F.left("text", (F.col("n") - half).cast("int")), "_head").alias("edited"))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Null texts are empty. Rows that repeat both id and text count once in the order and get
    the same results; null ids come last in it. With one document it is its own next.
    Empty input gives no rows. Other columns of docs are not read.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    row_key = F.unhex(F.md5(F.concat_ws(":", name, F.md5(whole.cast("binary"))).cast("binary")))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), row_key.alias("row_key"))
    own = staged(keyed.select("doc_id", "row_key", F.length("text").cast("long").alias("n"), fingerprint(F.col("text")).alias("own")), "own")
    once = own.dropDuplicates(["row_key"])
    following = _following(once)
    distinct = keyed.groupBy("row_key").agg(F.first("text").alias("text"))
    edited = edited_texts(distinct, following)
    edited = edited.select("row_key", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("changed"))
    edited = staged(edited, "edited")
    beside = following.drop("n").join(once.select(F.col("row_key").alias("next_key"), F.col("own").alias("beside")), "next_key")
    out = own.join(edited, "row_key").join(beside.drop("next_key"), "row_key")
    return out.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("beside")).alias("near_next"),
    )
