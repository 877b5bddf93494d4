"""Byte-level BPE: whole-batch pre-tokenisation, exact encoding by backtracking, decoding.

Pieces (the matches of the public GPT-2 pattern) are found for a megabyte of text by array
operations on character classes. Each distinct piece of a pass is encoded once; a bounded
memo carries encodings from pass to pass.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import BYTE_VALUES, Hashes, passes, text_bytes

#: Pieces whose encodings a worker remembers; the memo is emptied when full.
MEMO = 200_000

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """Letter, number, white space or other for each code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            found[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return found


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each match of public_tokenizers.PATTERN, and the number of the
    first piece of each document (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    cut = begins.copy()
    # A run that follows white space takes its last character if that is a space.
    after = np.flatnonzero(begins & ~first[:n] & (kind != _SPACE))
    after = after[kind[after - 1] == _SPACE]
    cut[after - 1] = True
    cut[after[points[after - 1] == 32]] = False
    # Contractions, where an apostrophe begins a piece.
    quote = np.flatnonzero((points == 39) & cut & begins)
    if len(quote):
        ends = np.flatnonzero(first)
        left = ends[np.searchsorted(ends, quote, "right")] - quote - 1
        padded = np.append(points, np.zeros(2, np.uint32))
        one, two = padded[quote + 1], padded[quote + 2]
        short = (left >= 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = (left >= 2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        cut = np.append(cut, True)
        cut[quote[short] + 1] = False
        cut[quote[short] + 2] = True
        cut[quote[long] + 1] = False
        cut[quote[long] + 3] = True
        cut = cut[:n]
    starts = at[np.flatnonzero(cut)]
    stops = np.append(starts[1:], len(data))
    return starts, stops, np.searchsorted(starts, offsets)


class PieceEncoder:
    """Ids of whole documents, given a function from a piece to its ids."""

    def __init__(self, encode: Callable[[bytes], list[int]], memo: int = MEMO):
        self.encode, self.memo, self.limit = encode, {}, memo
        self.pack = [struct.Struct(f"={n}I").pack for n in range(12)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and the place of each document's first (one more at the end)."""
        starts, stops, docs = pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, where, which = np.unique(Hashes(BYTE_VALUES[data]).of(starts, stops), return_index=True, return_inverse=True)
        raw, memo, found, pack = data.tobytes(), self.memo, [], self.pack
        for a, b in zip(starts[where].tolist(), stops[where].tolist()):
            piece = raw[a:b]
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= self.limit:
                    memo.clear()
                new = self.encode(piece)
                ids = memo[piece] = pack[len(new)](*new) if len(new) < len(pack) else np.array(new, np.uint32).tobytes()
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin = (np.cumsum(sizes) - sizes)[which]
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[docs]


def read_ranks(name: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(public_tokenizers.path(name), "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[k] for k in range(len(found))]


class Backtracker:
    """Exact BPE of one piece without a merge loop.

    The encoding is the one sequence of tokens in which each adjacent pair is what BPE
    makes of the two together. Take the longest match at each place; on an incompatible
    pair try shorter matches; if none is left drop the last token and mark the place as
    impossible. Each place is marked once at most, so the time is linear in the length.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.ids = tokens, {t: k for k, t in enumerate(tokens)}
        self.sizes = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        self.known: dict[tuple[int, int], bool] = {}
        for k, t in enumerate(tokens):
            self.parts.append(self._split(k, t))
        self.known.clear()

    def _prefix(self, token: bytes) -> int:
        """The longest other token that this one starts with, or -1."""
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)

    def _split(self, k: int, token: bytes) -> tuple[int, int]:
        """The two tokens of which merging makes this one; itself twice for a single byte."""
        left = self.shorter[k]
        while left >= 0:
            right = self.ids.get(token[self.sizes[left] :], k)
            if left < k and right < k and self._compatible(left, right):
                self.merged[left, right] = k
                return left, right
            left = self.shorter[left]
        return k, k

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two adjacent tokens as they are.

        Undo merges from the later one backwards, on the side that faces the other token;
        the pair is broken if two parts met whose merge ranks before the merge undone.
        """
        limit = len(self.tokens)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            for side in (0, 1) if left > right else (1, 0):
                whole = right if side else left
                part = self.parts[whole][0] if side else self.parts[whole][1]
                if part != whole:
                    limit = whole + side
                    left, right = (left, part) if side else (part, right)
                    break
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            found = self.known[left, right] = self._compatible(left, right)
        return found

    def __call__(self, piece: bytes) -> list[int]:
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        sizes, longest = self.sizes, [-1] * len(piece)
        for end, k in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[k]] = k  # a longer match from the same place ends later
        possible, out, at = bytearray(b"\1") * (len(piece) + 1), [], 0
        k = longest[0]
        while at < len(piece):
            while k >= 0 and not (possible[at + sizes[k]] and (not out or self.compatible(out[-1], k))):
                k = self.shorter[k]
            if k >= 0:
                out.append(k)
                at += sizes[k]
                k = longest[at] if at < len(piece) else -1
            else:
                possible[at] = 0
                k = out.pop()
                at -= sizes[k]
        return out


@functools.cache
def _encoder(name: str) -> PieceEncoder:
    return PieceEncoder(Backtracker(read_ranks(name)))


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text: doc_id, ids array<int>.

    Null and empty texts have no ids. Special tokens are ordinary text. One row for each
    row of docs, repeated rows included; a null id stays null. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _encoder(ranks)
        for batch in passes(batches):
            ids, places = to_ids(*text_bytes(batch.column("text")))
            column = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "ids"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The bytes of each row's ids: the columns of encode() and decoded binary.

    Null ids give null; ids outside the vocabulary raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(ranks)
        sizes = np.array([len(t) for t in tokens], np.int64)
        begin, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)
        for batch in passes(batches, "ids"):
            column = batch.column("ids")
            ids, rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            counts = sizes[ids]
            ends = np.append(0, np.cumsum(counts))
            data = flat[np.repeat(begin[ids] - ends[:-1], counts) + np.arange(ends[-1])]
            places = ends[np.append(0, np.cumsum(rows))]
            out = [None if empty else data[a:b].tobytes() for empty, a, b in zip(column.is_null().to_pylist(), places[:-1].tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of each document."""
    return decode(encode(docs, ranks), ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
