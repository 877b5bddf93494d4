"""Identifiers that only their contexts tell."""

import random

from texts import prose

from tradewind.llm import pii


def planted():
    """Key-shaped seeds and other identifiers behind the same words, in prose."""
    r = random.Random(3)
    rows, hidden = [], {}
    for k in range(60):
        seed = "".join(r.choice("0123456789abcdef") for _ in range(32))
        rows.append((k, f"{prose(k, 30)} access token = {seed} {prose(k + 500, 20)}"))
    for k in range(20):
        size = 5 if k % 2 else 80
        own = "Q" + "".join(r.choice("0123456789") for _ in range(size - 1))
        hidden[100 + k] = own
        rows.append((100 + k, f"{prose(k + 900, 12)} access token = {own} {prose(k + 700, 9)} lot 55512 here"))
    return rows, hidden


def test_unseen_identifiers_of_any_length(spark):
    rows, hidden = planted()
    found = {r["doc_id"]: r["identifier"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(any(s["value"] == own for s in found[k]) for k, own in hidden.items())
    assert right >= 0.9 * len(hidden)
    assert not any(s["value"] == "55512" for spans in found.values() for s in spans)


def test_many_matches_keep_their_places(spark):
    text = " ".join(f"{k}a a{k}@b.cd" for k in range(300))
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in row["email"]] == [(text.index(f" a{k}@") + 1, text.index(f" a{k}@") + 1 + len(f"a{k}@b.cd")) for k in range(300)]


def test_null_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "k", "f"), (None, "mail a@b.cd", "k", "f"), (None, "mail a@b.cd", "k", "f")], "doc_id long, text string, _key string, _found string")
    clean = pii.redact(docs).collect()
    assert sorted(r["text"] or "" for r in clean) == ["", "mail [EMAIL]", "mail [EMAIL]"]
    assert [r["_key"] for r in clean] == ["k"] * 3


def test_identifiers_leave_base_matches_alone(spark):
    """A token that holds an address is parted at it, for spans and for redaction."""
    rows = [(k, f"{prose(k, 12)} ticket {''.join(random.Random(k).choice('0123456789abcdef') for _ in range(30))}a1 closed") for k in range(40)]
    rows += [(100 + k, f"ticket abc{k};u{k}@b.co;x{k} closed") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_pii(docs).where("doc_id >= 100").collect():
        spans = sorted((s["start"], s["end"]) for kind in ("email", "ip", "card", "phone", "identifier") for s in r[kind])
        assert r["email"][0]["value"] == f"u{r['doc_id'] - 100}@b.co"
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert all("[EMAIL]" in r["text"] for r in pii.redact(docs).where("doc_id >= 100").collect())
