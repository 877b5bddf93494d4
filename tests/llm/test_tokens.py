import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradewind.llm import bpe, packing
from tradewind.llm.common import text_bytes

tiktoken = pytest.importorskip("tiktoken")


def library(name):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


MULTI = "byte_bpe_multi_50k.tiktoken"


def test_round_trip(docs, rows, nothing):
    enc = library(MULTI)
    expected = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip_digests(docs).collect())) == expected
    assert bpe.round_trip_digests(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t 'stremvld1½Az!?-éß日\U0001f600")), max_size=40), max_size=4))
def test_same_ids_as_the_library(texts):
    enc = library(MULTI)
    ids, places = bpe._encoder(MULTI)(*text_bytes(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == [enc.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abehlnorst ", min_size=1, max_size=300))
def test_backtracking_without_pieces(text):
    """Long single pieces, where merges and longest matches disagree most."""
    piece = text.replace(" ", "").encode()
    if piece:
        assert bpe._encoder(MULTI).encode(piece) == library(MULTI)._encode_single_piece(piece)


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack_documents(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(nothing).count() == 0


def sequential(lengths: list[int], sequence: int) -> int:
    """Sequences that best fit needs, longest piece first, one piece after the other."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else sequence) - n)
    return len(gaps)


KINDS = {
    "uniform": lambda r: r.randint(1, 64),
    "short": lambda r: min(64, 1 + int(r.expovariate(1 / 9))),
    "tiny": lambda r: r.choice([1, 2, 3]),
    "awkward": lambda r: r.choice([64, 33, 33, 22, 21, 1]),
    "full": lambda r: 64,
}


@pytest.mark.parametrize("kind", KINDS)
def test_packing_is_as_good_as_sequential_best_fit(spark, kind):
    """Whole and gapless, and within one of the bound or of one piece after the other."""
    r = random.Random(kind)
    lengths = [KINDS[kind](r) for _ in range(500)]
    pieces = spark.createDataFrame([(k, n, "x") for k, n in enumerate(lengths)], "doc_id long, length long, first string").repartition(3)
    got = packing.pack(pieces, 64).collect()
    assert Counter((p["doc_id"], p["length"], p["first"]) for p in got) == Counter((k, n, "x") for k, n in enumerate(lengths))
    places = defaultdict(list)
    for p in got:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in places.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64
    assert len(places) <= max(sequential(lengths, 64), -(-sum(lengths) // 64) + 1)


def test_superstep_takes_the_successor(spark):
    """Two gaps and three items of a kind: each item has the smallest gap that holds it."""
    rows = [("gap", 10, 100, 2, 0, 0), ("gap", 7, 200, 3, 0, 0), ("item", 6, 0, 4, 0, 0), ("item", 9, 0, 3, 0, 0)]
    out = packing.superstep(spark.createDataFrame(rows, packing._STATE), 0, 0, 16).collect()
    plans = {(s["size"], s["first"] + k, s["sequence"] + k, s["base"]) for s in out if s["kind"] == "plan" for k in range(s["n"])}
    assert {p[2:] for p in plans if p[0] == 9} == {(100, 6), (101, 6)} and {p[2:] for p in plans if p[0] == 6} == {(200, 9), (201, 9), (202, 9)}
    assert sorted(p[:2] for p in plans) == [(6, 0), (6, 1), (6, 2), (9, 0), (9, 1)]
    assert sorted((s["size"], s["first"], s["n"]) for s in out if s["kind"] == "item") == [(6, 3, 1), (9, 2, 1)]
    assert sum(s["n"] for s in out if s["kind"] == "gap") == 5
