"""Removal of every byte that a long repeated substring covers, by suffix sorting.

A window is a string of LENGTH bytes. Its anchor is the least hashed K-gram in it, the
leftmost of equal ones, so equal windows have equal anchors at equal places. Consecutive
windows with one anchor form a run of a few hundred bytes. Only runs whose anchor occurs
in another run can hold a repeated window. Equal runs are counted before anything is
gathered: all their windows are repeated. Only runs that share an anchor and differ meet
in a task, where their suffixes are sorted and adjacent common prefixes computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import BYTE_VALUES, Hashes, mix, passes, staged, text_bytes
from tradewind.llm.suffix_sort import repeated_starts

#: Bytes of a repeated string, and of the K-grams that anchor windows.
LENGTH, K = 400, 32
#: Bytes of text that share a task of suffix sorting, about.
BLOCK = 1 << 20
#: Distinct runs of one key beyond which they are dealt anew, by narrower parts; and the
#: windows of a part, from level to level. At one, a part is a window and is only counted.
CROWD, STEPS = 512, (64, 8, 1)


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """The place of the anchor of each window of one document."""
    places = np.arange(len(data) - K + 1)
    grams = Hashes(BYTE_VALUES[data]).of(places, places + K)
    least = ((grams >> np.uint64(32)) << np.uint64(32)) | places.astype(np.uint64)
    span, have = length - K + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, place of the anchor from the first window, and the
    hashes of the anchor and of all bytes, for each run of one document."""
    anchors = _anchors(data, length)
    first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    number = np.diff(np.append(first, len(anchors)))
    hashes, at = Hashes(BYTE_VALUES[data]), anchors[first]
    return first, number, at - first, hashes.of(at, at + K), hashes.of(first, first + number + length - 1)


def runs(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """The runs of every text (text_key, text) of `length` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            data, offsets = text_bytes(batch.column("text"))
            found, sizes = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                rows = _runs_of(data[a:b], length) if b - a >= length else None
                sizes.append(len(rows[0]) if rows else 0)
                if rows:
                    found.append(rows)
            if found:
                arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found)]
                owners = batch.column("text_key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([owners, *arrays], ["text_key", "first", "number", "at", "anchor", "run"])

    return keyed.mapInArrow(run, "text_key binary, first long, number long, at long, anchor long, run long")


def _distinct_texts(keyed: DataFrame) -> DataFrame:
    """One row for each text; copies meet before the shuffle."""
    return keyed.groupBy("text_key").agg(F.first("text").alias("text"))


_PART = "key long, anchor long, run long, at long, shift long, bytes binary"


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """The wanted runs of each text (text, wanted) with their bytes, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            data, offsets = text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            flat, counts = wanted.flatten(), wanted.value_lengths().to_numpy(zero_copy_only=False)
            first = flat.field("first").to_numpy() + np.repeat(offsets[:-1], counts)
            last = first + flat.field("number").to_numpy() + length - 1
            for at in range(0, len(first), 4096):
                part = slice(at, at + 4096)
                raw = [data[a:b].tobytes() for a, b in zip(first[part].tolist(), last[part].tolist())]
                columns = [flat.field(c)[part] for c in ("anchor", "anchor", "run", "at")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(raw), np.int64)), pa.array(raw, pa.binary())], [x.split()[0] for x in _PART.split(", ")])

    return texts.mapInArrow(run, _PART)


def _narrowed(parts: DataFrame, length: int, step: int) -> DataFrame:
    """Parts cut anew so that the distances from window to anchor fall in one class of
    `step`. All windows of a class hold the same core of length - step + 1 bytes, at one
    distance from the anchor; its hash and the class are the new key. Equal windows keep
    equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "bytes", 1 << 18):
            keep, raws, keys, ats, shifts = [], [], [], [], []
            for k, (raw, at) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("at").to_pylist())):
                data = np.frombuffer(raw, np.uint8)
                number = len(data) - length + 1
                kinds = np.arange((at - number + 1) // step, at // step + 1)
                core = Hashes(BYTE_VALUES[data]).of(at - kinds * step, at - (kinds + 1) * step + length + 1)
                for kind, key in zip(kinds.tolist(), mix(core + kinds.astype(np.uint64)).view(np.int64).tolist()):
                    a, b = max(0, at - (kind + 1) * step + 1), min(number, at - kind * step + 1)
                    keep.append(k)
                    raws.append(raw[a : b + length - 1])
                    keys.append(key)
                    ats.append(at - a)
                    shifts.append(a)
            if keep:
                take = pa.array(keep)
                shift = pa.array(batch.column("shift").take(take).to_numpy() + np.array(shifts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("anchor").take(take), batch.column("run").take(take), pa.array(ats, pa.int64()), shift, pa.array(raws, pa.binary())], [x.split()[0] for x in _PART.split(", ")])

    return parts.mapInArrow(run, _PART)


def _sorted_marks(length: int):
    """Windows that two parts of a block hold, as intervals of windows of their runs."""

    def run(table: pa.Table) -> pa.Table:
        data, offsets = text_bytes(table["bytes"])
        repeated = repeated_starts(data, np.repeat(offsets[1:], np.diff(offsets)), length)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
        low, high = edges[::2], edges[1::2]  # never across rows: the last bytes of one begin no window
        rows = np.searchsorted(offsets, low, "right") - 1
        shift = table["shift"].combine_chunks().to_numpy()[rows] - offsets[rows]
        take = pa.array(rows)
        return pa.table({"anchor": table["anchor"].take(take), "run": table["run"].take(take), "low": low + shift, "high": high + shift})

    return run


_MARK = "anchor long, run long, low long, high long"


def _marks(parts: DataFrame, length: int) -> DataFrame:
    """(anchor, run, low, high): the windows that parts of different runs share."""
    spark, out = parts.sparkSession, None
    for step in (None, *STEPS):
        if step:
            parts = _narrowed(parts, length, step)
        parts = staged(parts, "parts")
        if step == 1:  # a part is a window; its key and a second hash tell it
            parts = parts.withColumn("key", F.struct("key", F.xxhash64("bytes").alias("other"))).drop("bytes")
        counts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1")
        met = parts.join(staged(counts, "counts"), "key")  # a key with many parts can be split
        if step == 1:
            return out.union(met.select("anchor", "run", F.col("shift").alias("low"), (F.col("shift") + 1).alias("high")))
        met = staged(met, "met")
        few = met.where(F.col("_many") <= CROWD)
        total = few.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        blocks = max(1, -(-total // BLOCK))
        few = few.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(blocks))).drop("_many", "key", "at")
        few = few.repartition(blocks, "_block")  # a task for each, however few its bytes
        found = staged(few.groupBy("_block").applyInArrow(_sorted_marks(length), _MARK), "marks")
        out = out.union(found) if out else found
        parts = met.where(F.col("_many") > CROWD).drop("_many")
        if parts.isEmpty():
            return out
    raise AssertionError(spark)


def _keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("text"), F.unhex(F.md5(raw.cast("binary"))).alias("text_key"))


def repeated_windows(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_key, spans): for each text with any, the intervals [low, high) of window starts
    whose `length` bytes also start somewhere else."""
    every = staged(runs(keyed.select("text_key", "text"), length), "runs")
    where = F.struct("text_key", "first", "number", "at")
    distinct = staged(every.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("w")), "distinct")
    kinds = distinct.groupBy("anchor").agg(F.min("run").alias("_p"), F.max("run").alias("_q")).where("_p < _q").select("anchor")
    kinds = staged(kinds, "kinds")
    mixed = distinct.join(kinds, "anchor").select("w.text_key", F.struct("anchor", "run", "w.first", "w.number", "w.at").alias("r"))
    wanted = mixed.groupBy("text_key").agg(F.collect_list("r").alias("wanted"))
    texts = _distinct_texts(keyed).join(wanted.hint("shuffle_hash"), "text_key").select("text", "wanted")
    marks = _marks(_cut(texts, length), length)
    same = distinct.where("n > 1").select("anchor", "run", F.lit(0).cast("long").alias("low"), F.col("w.number").alias("high"))
    marks = marks.union(same)
    spans = every.join(marks, ["anchor", "run"]).select("text_key", F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")).alias("span"))
    return staged(spans.groupBy("text_key").agg(F.collect_set("span").alias("spans")), "spans")


def kept_bytes(keyed: DataFrame, windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each text with repeated windows: text_key, removed (its maximal removed byte runs)
    and kept, the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            data, offsets = text_bytes(batch.column("text"))
            kept, removed = [], []
            for k, spans in enumerate(batch.column("spans")):
                own = data[offsets[k] : offsets[k + 1]]
                steps = np.zeros(len(own) + 1, np.int64)
                low, high = spans.values.field("low").to_numpy(), spans.values.field("high").to_numpy()
                np.add.at(steps, low, 1)
                np.add.at(steps, high + length - 1, -1)
                covered = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                removed.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                kept.append(own[~covered].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(removed, kind), pa.array(kept, pa.binary())], ["text_key", "removed", "kept"])

    texts = _distinct_texts(keyed.select("text_key", "text")).join(windows.hint("shuffle_hash"), "text_key")
    return texts.select("text_key", "text", "spans").mapInArrow(run, "text_key binary, removed array<struct<start:long,end:long>>, kept binary")


def substring_dedup(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Texts are UTF-8 bytes, null is empty. A byte goes if a `length`-byte string that covers
    it also starts anywhere else, in the same or another document; a copied document of
    that length goes wholly, all copies alike. Texts shorter than that stay whole. Rows
    with a null or repeated id are documents of their own. Empty input gives no rows.
    """
    keyed = _keyed(docs, doc_id, text)
    whole = keyed.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    cut = kept_bytes(keyed, repeated_windows(keyed, length), length).select(
        "text_key", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    out = whole.join(staged(cut, "cut"), "text_key", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"))


#: Every window by its hash, in SQL; for small tables.
ORACLE = """
WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT r, i, md5(raw[i:i + 399]) AS h FROM (SELECT r, raw, unnest(range(1, n - 398)) AS i FROM b WHERE n >= 400)),
rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
steps AS (SELECT r, i, max(i + 399) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM rep),
marks AS (SELECT r, i, sum(CASE WHEN upto IS NULL OR upto < i - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM steps),
gone AS (SELECT r, g, min(i) AS low, max(i) + 399 AS high FROM marks GROUP BY r, g),
kept AS (
  SELECT r, upto + 1 AS low, low - 1 AS high FROM (SELECT r, low, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS upto FROM gone)
  UNION ALL SELECT gone.r, max(high) + 1, max(n) FROM gone JOIN b USING (r) GROUP BY gone.r
), text AS (SELECT r, string_agg(hex(raw[low:high]), '' ORDER BY low) AS rest FROM kept JOIN b USING (r) WHERE high >= low GROUP BY r),
cut AS (SELECT r, sum(high - low + 1) AS removed, count(*) AS spans FROM gone GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       CASE WHEN removed IS NULL THEN sha256(raw) ELSE sha256(coalesce(unhex(rest), encode(''))) END AS kept_sha256
FROM b LEFT JOIN cut USING (r) LEFT JOIN text USING (r)
"""
