"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best fit. Pieces are range-sorted by length, which gives each its rank
among the pieces of its length without gathering a length in one task. Pieces by length and
gaps by size, each with a count, are tables; in a superstep both are sorted, items are
matched to their successor gaps by a sweep that is spread over the levels of a stack, ranks
settle who gets which gap, gaps are updated, and the tables are written for the next step,
until no piece is left. What steps decide are rank intervals; each piece then finds its own
by a join on length and rank.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewind.llm.bpe import PieceEncoder
from tradewind.llm.common import passes, staged, text_bytes

#: Tokens in a sequence.
SEQUENCE = 1024
#: Follows each document.
END_ID = 2
_MARK = b"<|endoftext|>"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Items shorter than the longest divided by this wait for a later step; slots of a gap in one step.
HOLD, SLOTS = 2, 64


@functools.cache
def _tokenizer(name: str) -> tuple[Tokenizer, PieceEncoder]:
    """The library's tokenizer, and an encoder of pieces by its model alone, which sees each
    byte as one of the 256 characters of the byte-level alphabet."""
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    shown = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or k >= 174]
    hidden = [k for k in range(256) if k not in shown]
    letters = {k: chr(k) for k in shown} | {k: chr(256 + n) for n, k in enumerate(hidden)}
    tokens = whole.model.tokenize
    return whole, PieceEncoder(lambda piece: [t.id for t in tokens(piece.decode("latin-1").translate(letters))])


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as token pieces of at most `sequence` ids: doc_id, piece, start, length,
    ids_crc32, and ids array<int> if keep_ids.

    A document is its ids and then END_ID; a null or empty text is END_ID alone. Only a
    longer document is cut: all its pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, encode = _tokenizer(tokenizer)
        for batch in passes(batches):
            data, offsets = text_bytes(batch.column("text"))
            ids, places = encode(data, offsets)
            raw, rows = data.tobytes(), []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[places[k] : places[k + 1]]
                one = raw[offsets[k] : offsets[k + 1]]
                if _MARK in one:  # the library reads its special token inside a text as such
                    own = np.array(whole.encode(one.decode(), add_special_tokens=False).ids, np.uint32)
                own = np.append(own, np.uint32(END_ID))
                start, piece = 0, 0
                while start < len(own):
                    stop = start + ((len(own) - start - 1) % sequence + 1 if piece == 0 else sequence)
                    part = own[start:stop]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), *([part.view(np.int32)] if keep_ids else [])))
                    start, piece = stop, piece + 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names[: len(rows[0])])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, _PIECES + ", ids array<int>" * keep_ids)


_STATE = "kind string, size long, first long, n long, sequence long, base long"


def superstep(state: DataFrame, opened: int, first: int, sequence: int = SEQUENCE) -> DataFrame:
    """One bulk-synchronous step: every slot of a gap may take one item, every item at most one slot.

    state: items (n pieces of `size` tokens, from rank `first` among those) and gaps (n
    sequences from `first` with `size` free places); `opened` empty sequences from number
    `first` join the gaps. A gap has as many slots of equal width as it is times as wide as
    the largest item, one at least and SLOTS at most. Slots and items are sorted by size, largest first,
    slots before items of their size. Swept in that order, an item takes the smallest slot
    still free that is wide enough: its successor. Who gets which is a matter of ranks: a
    row of slots lies on the levels of a stack, an item takes the top levels, and on each
    level an item's partner is the row before it. Levels are swept apart, so the sweep is
    spread over them.

    Items shorter than the largest divided by HOLD wait, and gaps that no item fits are dropped.
    Returns the next state: items that got no slot, gaps as they are now, and `plan` rows: n
    pieces of `size` tokens from rank `first`, one in each of the sequences from `sequence`,
    at offset `base`.
    """
    spark = state.sparkSession
    long = lambda v: F.lit(v).cast("long")
    # What differs from step to step comes as rows, so that all steps run the same compiled code.
    opened_rows = spark.createDataFrame([("gap", sequence, first, opened, 0, 0)] if opened else [], _STATE)
    every = Window.partitionBy(F.lit(0))  # some rows for each pair of lengths, whatever the input
    gap = F.col("kind") == "gap"
    largest = F.max(F.when(~gap, F.col("size"))).over(every)
    rows = state.where("kind <> 'plan'").unionByName(opened_rows).withColumn("takes_part", gap | (F.col("size") * HOLD >= largest))
    rows = rows.withColumn("least", F.min(F.when(~gap, F.col("size"))).over(every)).where(~gap | (F.col("size") >= F.col("least")))
    waiting = rows.where("NOT takes_part").select(*state.columns)
    rows = rows.where("takes_part").select("kind", "size", "first", "n")
    slots = F.when(gap, F.least(F.greatest(F.floor(F.col("size") / largest), long(1)), long(SLOTS))).otherwise(1)
    rows = rows.withColumn("slots", slots).withColumn("slot", F.explode(F.sequence(long(0), F.col("slots") - 1)))
    rows = rows.withColumn("room", F.col("size")).withColumn("size", F.floor(F.col("size") / F.col("slots")))
    order = Window.orderBy(F.desc("size"), F.when(gap, 0).otherwise(1), "first", "slot")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The stack's height never falls below zero: items that find it empty take nothing.
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("x", F.sum(F.when(gap, F.col("n")).otherwise(-F.col("n"))).over(so_far))
    rows = rows.withColumn("h", F.col("x") - F.least(long(0), F.min("x").over(so_far)))
    rows = rows.withColumn("before", F.coalesce(F.lag("h").over(order), long(0)))
    rows = rows.withColumn("cuts", F.array_sort(F.array_union(F.array(long(0)), F.collect_set("h").over(every))))
    cells = rows.select(F.struct("kind", "pos", "size", "room", "slot", "first", "before", "h").alias("r"), F.explode(_between("cuts", F.least("h", "before"), F.greatest("h", "before"))).alias("c"))
    upwards = Window.partitionBy("c.low").orderBy("r.pos")
    met = cells.select("r", "c", F.lead("r").over(upwards).alias("i")).where("r.kind = 'gap'")
    # Levels of a pair, and those that a slot keeps, lie side by side: one row for each.
    pairs = met.groupBy("r", "i").agg(F.min("c.low").alias("low"), F.max("c.high").alias("high"))
    begin = F.col("r.first") + F.col("low") - F.col("r.before")
    pairs = pairs.select("r", "i", "low", begin.alias("a"), (begin + F.col("high") - F.col("low")).alias("b"))
    # The slots of a run of sequences are laid over each other: what stands in one sequence adds up.
    run = Window.partitionBy("r.first")
    pairs = pairs.withColumn("cuts", F.array_sort(F.array_union(F.collect_set("a").over(run), F.collect_set("b").over(run))))
    parts = pairs.select("r", "i", "low", "a", F.explode(_between("cuts", F.col("a"), F.col("b"))).alias("c"))
    inside = Window.partitionBy("r.first", "c.low").orderBy("r.slot")
    size = F.coalesce("i.size", long(0))
    parts = parts.withColumn("under", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), long(0)))
    parts = parts.withColumn("filled", F.sum(size).over(Window.partitionBy("r.first", "c.low")))

    def row(**fields: Column) -> Column:
        given = {"kind": F.lit("gap"), "size": long(0), "first": F.col("c.low"), "n": F.col("c.high") - F.col("c.low"), "sequence": long(0), "base": long(0)}
        return F.struct(*(c.alias(k) for k, c in (given | fields).items()))

    rank = F.col("i.first") + F.col("low") - F.col("i.h") + F.col("c.low") - F.col("a")
    placed = row(kind=F.lit("plan"), size=F.col("i.size"), first=rank, sequence=F.col("c.low"), base=sequence - F.col("r.room") + F.col("under"))
    rest = row(size=F.col("r.room") - F.col("filled"))
    made = F.array_compact(F.array(F.when(F.col("i").isNotNull(), placed), F.when(F.col("r.slot") == 0, rest)))
    after = parts.select(F.explode(made).alias("s")).select("s.*").where("size > 0")
    left = F.col("n") - (F.col("before") - F.col("h"))
    items = rows.where(~gap).withColumn("left", left).where("left > 0")
    kept = F.col("first") + F.col("n") - F.col("left")
    items = items.select("kind", "size", kept.alias("first"), F.col("left").alias("n"), long(0).alias("sequence"), long(0).alias("base"))
    return after.unionByName(items).unionByName(waiting)


def _between(cuts: str, low: Column, high: Column) -> Column:
    """The stretches (low, high) that sorted cuts part an interval into; both ends are cuts."""
    at, many = F.array_position(cuts, low).cast("int"), (F.array_position(cuts, high) - F.array_position(cuts, low)).cast("int")
    return F.when(high > low, F.arrays_zip(F.slice(cuts, at, many).alias("low"), F.slice(cuts, at + 1, many).alias("high")))


def best_fit(lengths: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Where the pieces of each length go: lengths (length, n) as `plan` rows of `superstep`.

    Supersteps until no piece is left. Sequences are opened as soon as the pieces' tokens
    exceed the free places, and for pieces that are longer than every gap: one for each
    above half a sequence, and no fewer than their tokens need. Short pieces wait for the
    long ones, which leave them gaps. The tables of a step have some rows for each pair of
    lengths, whatever the number of pieces; each step's are written and read again.
    """
    spark = lengths.sparkSession
    none = F.lit(0).cast("long")
    state = staged(lengths.select(F.lit("item").alias("kind"), F.col("length").alias("size"), none.alias("first"), "n", none.alias("sequence"), none.alias("base")), "packing")
    plans, sequences = [], 0
    size, n, item, gap = F.col("size"), F.col("n"), F.col("kind") == "item", F.col("kind") == "gap"
    every = Window.partitionBy(F.lit(0))
    while True:
        seen = state.where("kind <> 'plan'").withColumn("widest", F.coalesce(F.max(F.when(gap, size)).over(every), F.lit(0))).withColumn("least", F.min(F.when(item, size)).over(every))
        stuck = item & (size > F.col("widest"))
        usable = gap & (size >= F.col("least"))
        sums = [F.sum(F.when(c, v)) for c, v in ((item, size * n), (usable, size * n), (stuck & (size * 2 > sequence), n), (stuck, size * n))]
        tokens, free, large, lost = (x or 0 for x in seen.agg(*sums).first())
        if not tokens:
            break
        opened = max(large, -(-lost // sequence), -(-(tokens - free) // sequence), 0)
        state = staged(superstep(state, opened, sequences, sequence), "packing")
        sequences += opened
        plans.append(state.where("kind = 'plan'"))
    return functools.reduce(DataFrame.unionByName, plans, state.where("false"))


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces with sequence_id and offset; all other columns stay.

    Sequences are gapless from offset 0. Empty input gives no rows; repeated rows are
    packed each; pieces of equal length are ranked by their place after the range sort.
    Pieces must be 1 to `sequence` long.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in ("length", "doc_id", "start") if c in pieces.columns]
    ranged = pieces.repartitionByRange(parts, *order).sortWithinPartitions("length").withColumn("_place", F.monotonically_increasing_id())
    ranged = staged(ranged, "ranged")
    part = F.shiftright("_place", 33).alias("_part")
    # A length's pieces lie side by side: at most (partitions + lengths) of these rows.
    held = staged(ranged.groupBy("length", part).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")), "held")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col("length").alias("_length"), "_part", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero"))
    plan = best_fit(held.groupBy("length").agg(F.sum("_n").alias("n")), sequence)
    plan = plan.select(F.col("size").alias("_size"), F.col("first").alias("_from"), (F.col("first") + F.col("n")).alias("_until"), F.col("sequence").alias("_sequence"), F.col("base").alias("_base"))
    ranked = ranged.join(starts, (F.col("length") == F.col("_length")) & (F.shiftright("_place", 33) == F.col("_part")))
    ranked = ranked.withColumn("_rank", F.col("_place") - F.col("_zero"))
    # Both sides by length: a common length's pieces are many for a few intervals each.
    placed = ranked.join(plan, (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_until")))
    return placed.select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_base").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents; the tokenised pieces are written once."""
    return pack(staged(token_pieces(docs, tokenizer, sequence, keep_ids), "pieces"), sequence)
