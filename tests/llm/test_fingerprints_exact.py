"""Fingerprints and their likeness against a plain re-computation."""

import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from texts import prose

from tradewind.llm import fingerprints

LETTERS = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Arabic}\p{Hebrew}\p{Hangul}\p{M}]"
TOKEN = regex.compile(rf"(?<!{LETTERS}){LETTERS}{{1,24}}+(?!{LETTERS})|(?<![0-9])[0-9]{{1,24}}+(?![0-9])|[^ \n\t\r\f\v]")


def hashed(*values):
    """The 64-bit hash of a row of texts and numbers, as the engine defines it."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def anchors(text):
    tokens = [hashed(t) for t in TOKEN.findall(text)]
    pairs = [hashed(a, b) for a, b in zip(tokens, tokens[1:])]
    found = {}
    for i in range(len(pairs) - fingerprints.WINDOW + 2):
        inner = pairs[i : i + fingerprints.WINDOW - 1]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(hashed(*inner[::2]), i)
    every = sorted(found.items())
    kept = [x for k, x in enumerate(every) if k < 32 or x[0] < fingerprints.LOW]
    return kept or ([(hashed(text), 0)] if text else [])


def alike(a, b):
    if not a or not b:
        return float(a == b)
    upto = min((1 << 63) - 1 if len(x) < 32 else max(x[-1][0], fingerprints.LOW) for x in (a, b))
    p, q = ({h: i for h, i in x if h <= upto} for x in (a, b))
    shifts = sorted(q[h] - p[h] for h in p if h in q)
    near = [s for s in shifts if abs(s - shifts[len(shifts) // 2]) <= fingerprints.SLACK]
    return 2 * len(near) / (len(p) + len(q))


def texts():
    r = random.Random(5)
    base = [prose(k, n) for k, n in enumerate((3, 9, 20, 60, 400, 2500))]
    odd = ["", "日本語の文章です。" * 30, "x" * 500, "a1b2 " * 40, "ñandú, 12-34! " * 30, "".join(r.choice("abc") for _ in range(900))]
    return base + odd + [t[: len(t) // 2] + "Z" + t[len(t) // 2 :] for t in base + odd]


def test_fingerprints_and_likeness(spark):
    every = texts()
    pairs = [(x, y) for k, x in enumerate(every) for y in (every[k - 1], every[(k + len(every) // 2) % len(every)], x)]
    df = spark.createDataFrame(pairs, "x string, y string")
    df = df.select("x", "y", fingerprints.fingerprint(F.col("x")).alias("a"), fingerprints.fingerprint(F.col("y")).alias("b"))
    for x, y, a, b, near in df.select("*", fingerprints.likeness(F.col("a"), F.col("b"))).collect():
        assert [tuple(v) for v in a] == anchors(x)
        assert near == pytest.approx(alike(anchors(x), anchors(y))), (x[:40], y[:40])
        assert x != y or near == 1.0


def test_insertion_in_a_text_without_spaces(spark):
    r = random.Random(9)
    text = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(1500))
    df = spark.createDataFrame([(text, text[:700] + "新" + text[700:])], "x string, y string")
    assert df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("x")), fingerprints.fingerprint(F.col("y")))).first()[0] > 0.9


def test_one_document_is_its_own_next(spark):
    row = fingerprints.fingerprint_documents(spark.createDataFrame([(1, prose(1, 50))], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0


def test_a_short_text_is_like_itself_half_edited(spark):
    """Every text of a line or two keeps anchors in the half that stays."""
    rows = [(k, prose(k, 12 + k % 10)) for k in range(60)]
    rows += [(100 + k, f"{prose(k, 6)} {k}. {prose(k + 7, 8)}") for k in range(20)]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["near_edited"] > 0 for r in got), [(r["n_chars"], r["near_edited"]) for r in got if not r["near_edited"]]
    assert 0.25 < sum(r["near_edited"] for r in got) / len(got) < 0.75
