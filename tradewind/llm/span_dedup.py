"""Substring dedup by sliding sentence spans.

A span is a run of sentences just long enough: the shortest from each sentence on and the
shortest up to each sentence. Spans are hashed; hashes are joined globally; sentences that
a repeated span covers go, but for the span's first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import BYTE_VALUES, Hashes, passes, signed, text_bytes, words

#: Sentences in a span, the words it must have, and the words among which a word with the
#: least hash begins a new part of a long sentence. A part counts as a sentence for each
#: CUT words begun, so that a span covers a passage of some fifty words however it is
#: punctuated. Spans of short sentences take in further ones until they have the words.
SPAN, LEAST_WORDS, CUT = 3, 12, 8
#: Last bytes of sentence ends, and marks that may close a sentence after its end.
_ENDS = [c.encode() for c in ".!?|…。！？．｡।॥؟۔։።။។"]
_CLOSES = [c.encode() for c in "\"')]}”’»›」』）】》"]


def _marked(data: np.ndarray, marks: list[bytes], whole: bool) -> np.ndarray:
    """Which bytes end (or, if whole, belong to) one of the marks."""
    one = np.zeros(256, bool)
    one[[m[0] for m in marks if len(m) == 1]] = True
    out = one[data]
    high = np.flatnonzero(data >= 0x80)
    for size in (2, 3):
        at = high[high >= size - 1]
        code = sum(data[at - k].astype(np.int64) << 8 * k for k in range(size))
        hit = at[np.isin(code, [int.from_bytes(m) for m in marks if len(m) == size])]
        for k in range(size if whole else 1):
            out[hit - k] = True
    return out


def _spaceless(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a character of a script without spaces: Thai, Lao, Burmese, Khmer,
    kana, Han and their punctuation. Hangul has spaces."""
    out = np.zeros(len(data), bool)
    high = np.flatnonzero(data >= 0xE0)
    high = high[high < len(data) - 1]
    lead, second = data[high], data[high + 1]
    wide = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F))
    wide |= (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xEF) & ((second == 0xBC) | (second == 0xBD)) | (lead == 0xF0) & (second >= 0xA0)
    out[high[wide]] = True
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _units(data: np.ndarray, offsets: np.ndarray):
    """words(), each character of a script without spaces being a word of its own, and
    what each is worth: a word 2, such a character 1."""
    starts, ends, docs, hashes = words(data, offsets)
    at = np.flatnonzero(_spaceless(data))
    if not len(at):
        return starts, ends, docs, hashes, np.full(len(starts), 2)
    lead = data[at]
    after = at + np.where(lead >= 0xF0, 4, 3)
    first = np.union1d(starts, np.concatenate([at, after[~np.isin(after, ends)]]))
    last = np.union1d(ends, np.concatenate([after, at[~np.isin(at, starts)]]))
    worth = np.where(np.isin(first, at), 1, 2)
    docs = np.searchsorted(offsets, first, "right") - 1
    return first, last, docs, Hashes(BYTE_VALUES[_LOWER[data]]).of(first, last), worth


def _sentences(data: np.ndarray, offsets: np.ndarray):
    """First and last word of each sentence or part of one, its document, the words
    themselves, and what words are worth."""
    starts, ends, docs, hashes, worth = _units(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), docs, (starts, ends, hashes, worth)
    lines = np.cumsum(data == 10)
    closing = _marked(data, _CLOSES, True)
    place = np.arange(len(data))
    before = np.maximum.accumulate(np.where(closing, -1, place))  # the last byte that closes nothing
    stop = _marked(data, _ENDS, False)[before] & (before >= 0)
    new = np.ones(n, bool)
    new[1:] = stop[ends[:-1] - 1] & ~((before[ends[1:] - 1] < starts[1:]) & (starts[1:] == ends[:-1]))
    new[1:] |= (docs[1:] != docs[:-1]) | (lines[starts[1:]] > lines[ends[:-1] - 1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, length)
    # Words after which so many of the sentence follow as the window needs; the cut depends on
    # the window's words alone, so it falls on the same word wherever the passage stands.
    back, on = (CUT - 1) // 2, CUT // 2
    cut = np.flatnonzero((place >= back) & (place + on < np.repeat(length, length)))
    for k in range(-back, on + 1):
        cut = cut[hashes[cut] <= hashes[cut + k]]
    new[cut] = True
    low = np.flatnonzero(new)
    return low, np.append(low[1:], n), docs[low], (starts, ends, hashes, worth)


def _spans(owner: np.ndarray, weights: np.ndarray, halves: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one sentence of the shortest runs, from each sentence on and up to
    each sentence, that weigh `size` and have LEAST_WORDS words; a text without any is one.

    A shared passage that has enough is covered whole: the run from its first sentence
    covers those up to that run's end, and the run up to any later one lies inside it.
    """
    n = len(owner)
    weight, length = (np.append(0, np.cumsum(x)) for x in (weights, halves))
    begin, end = np.searchsorted(owner, owner), np.searchsorted(owner, owner, "right")
    k = np.arange(n)
    to = np.maximum(np.searchsorted(weight, weight[:-1] + size), np.searchsorted(length, length[:-1] + 2 * LEAST_WORDS))
    since = np.minimum(np.searchsorted(weight, weight[1:] - size, "right"), np.searchsorted(length, length[1:] - 2 * LEAST_WORDS, "right")) - 1
    on, up = to <= end, since >= begin
    whole = (k == begin) & ~on
    pairs = np.concatenate([k[on] * (n + 1) + to[on], since[up] * (n + 1) + k[up] + 1, k[whole] * (n + 1) + end[whole]])
    pairs = np.unique(pairs)
    return pairs // (n + 1), pairs % (n + 1)


def spans(docs: DataFrame, size: int = SPAN) -> DataFrame:
    """(doc, text_hash, at, span): each span by its place, the number of its first sentence
    times 2 ** 32 and the number of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            low, high, owner, (_, _, hashes, worth) = _sentences(*text_bytes(batch.column("text")))
            if not len(low):
                continue
            worth = np.append(0, np.cumsum(worth))
            halves = worth[high] - worth[low]
            k, to = _spans(owner, -(-halves // (2 * CUT)), halves, size)
            own = owner[k]
            at = (k - np.searchsorted(owner, own) << 32) + to - k
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("text_hash").take(take), pa.array(at), pa.array(signed(Hashes(hashes).of(low[k], high[to - 1])))],
                ["doc", "text_hash", "at", "span"],
            )

    return docs.mapInArrow(run, "doc long, text_hash long, at long, span long")


def span_dedup(docs: DataFrame, size: int = SPAN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_text for each row of docs.

    Words are runs of non-space bytes, A-Z as a-z, and in scripts without spaces two
    characters; sentences end at . ! ? and the like, marks that close quotes or brackets
    included, or at a line's end, and long ones are parted at words with the least hash
    around. A text too short for a span is one. First is the smallest id, then the
    smallest place; null ids come last. Null texts are empty. Rows that repeat id and text
    are one document. What stays of a changed text are its sentences with the space after
    them; other texts stay as they are. Empty input gives no rows.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    last = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), last.alias("doc"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    every = spans(rows.select("doc", "text_hash", "text"), size).repartition("span")  # one shuffle for both sides
    where = F.struct("doc", "text_hash", "at")
    firsts = every.groupBy("span").agg(F.min(where).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = every.join(firsts.hint("merge"), "span").where(where != F.col("_first"))
    gone = later.groupBy("doc", "text_hash").agg(F.collect_set("at").alias("gone"))
    joined = rows.join(gone.hint("shuffle_hash"), ["doc", "text_hash"], "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            data, offsets = text_bytes(batch.column("text"))
            low, _, owner, (starts, _, _, _) = _sentences(data, offsets)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            raw, n_all, n_gone, kept = data.tobytes(), [], [], []
            for d, marks in enumerate(batch.column("gone").to_pylist()):
                a, b = cuts[d], cuts[d + 1]
                n_all.append(int(b - a))
                if not marks:
                    n_gone.append(0)
                    kept.append(raw[offsets[d] : offsets[d + 1]].decode())
                    continue
                marks = np.array(marks)
                first, number = marks >> 32, marks & 0xFFFFFFFF
                edge = np.bincount(first, minlength=b - a + 1) - np.bincount(first + number, minlength=b - a + 1)
                covered = np.cumsum(edge[:-1]) > 0
                edges = np.append(starts[low[a:b]], offsets[d + 1])
                edges[0] = offsets[d]
                n_gone.append(int(covered.sum()))
                kept.append(b"".join(raw[x:y] for x, y, gone in zip(edges[:-1].tolist(), edges[1:].tolist(), covered.tolist()) if not gone).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_all, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, kept_text string")
