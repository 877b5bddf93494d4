import hashlib
import re
from collections import Counter

import numpy as np
from texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tradewind.llm import fingerprints, pii, quality, span_dedup, substring_dedup, toxicity
from tradewind.llm.suffix_sort import repeated_starts, suffix_array


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def spans_of(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in PLAIN.items()}


def test_pii_base(docs, rows, nothing):
    expected = Counter()
    for i, t in rows:
        found = spans_of(t)
        line = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in found[k])
        expected[i, *(len(found[k]) for k in PLAIN), hashlib.sha256(line.encode()).hexdigest()] += 1
    got = pii.span_digests(pii.find_pii(docs)).collect()
    assert Counter(tuple(r)[:6] for r in got) == expected
    assert pii.find_pii(nothing).count() == 0


def test_pii_odd_texts(spark):
    texts = ["a@b.c_d@e.f", "x@y.z@q.r.s", "1.2.3.4.5.6.7.8.9", "000255.0.0.256 0.0.0.00255", "+1234567-(", "9" * 5000, "a." * 3000 + "@b.c", "+1 2 3 4 5 6 7 8", "é😀 a@b.co"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        expected = spans_of(texts[r["doc_id"]])
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in PLAIN} == expected, texts[r["doc_id"]][:40]


def test_pii_contexts_find_identifiers(spark):
    """Cards after "card number" seed the pattern; a number that is no card is then found."""
    texts = [f"{prose(k, 12)} card number 411111111111{1000 + k} thanks {prose(50 + k, 5)}" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_pii(docs).collect()
    valid = sum(bool(r["card"]) for r in found)
    assert 20 <= valid <= 60
    # One valid card in ten is not enough; with most of them valid the rest follow.
    good = [t for k, t in enumerate(texts) if spans_of(t)["card"]]
    mixed = good[:30] + [f"{prose(900 + k, 9)} card number AB-99{k}77 thanks" for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert [found[30 + k]["identifier"][0]["value"] for k in range(5)] == [f"AB-99{k}77" for k in range(5)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert all("[IDENTIFIER]" in clean[30 + k] and "77" not in clean[30 + k] for k in range(5))
    assert all("[CARD]" in clean[k] for k in range(30))


def test_redact_keeps_columns_and_clean_texts(docs, rows):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = Counter(r["text"] for r in out.collect())
    assert all(texts[t] for i, t in rows if t and "@" not in t and not re.search("[0-9]", t))


def brute_removal(rows, length):
    starts = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        starts.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edges = np.diff(np.concatenate([[0], gone.astype(int)])) == 1
        out[i, len(b), int(gone.sum()), int(edges.sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(docs, rows, nothing):
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs).collect())) == brute_removal(rows, 400)
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_suffix_dedup_of_a_crowd(spark, monkeypatch):
    """More runs of one anchor than a task takes: every level of narrowing is used."""
    monkeypatch.setattr(substring_dedup, "CROWD", 4)
    passage = prose(5, 70)
    rows = [(k, f"{prose(100 + k, 40 + k)} {passage[: 450 + k]} {prose(200 + k % 7, 50)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs).collect())) == brute_removal(rows, 400)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=60), st.integers(1, 20))
def test_suffix_sorting(text, length):
    data = np.frombuffer(text.encode(), np.uint8)
    assert suffix_array(data, len(text) + 8).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    windows = Counter(text[k : k + length] for k in range(len(text) - length + 1))
    got = repeated_starts(data, np.full(len(data), len(data)), length)
    assert got.tolist() == [k + length <= len(text) and windows[text[k : k + length]] > 1 for k in range(len(text))]


def test_fingerprints(docs, rows, nothing):
    unique = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(f"{r[0] if r[0] is not None else 'null'}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).digest()))
    edited = {}
    for k, (i, t) in enumerate(unique):
        half = len(t) // 2
        after = unique[(k + 1) % len(unique)][1]
        edited[i, hashlib.md5(t.encode()).hexdigest()] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    got = fingerprints.fingerprint_documents(docs).collect()
    expected = Counter((i, *edited[i, hashlib.md5((t or "").encode()).hexdigest()]) for i, t in rows)
    assert Counter(tuple(r)[:3] for r in got) == expected
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["fingerprint"] == by_id[30]["fingerprint"] == by_id[31]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert by_id[31]["near_next"] == 1.0  # 31 is followed by its copy 30
    assert by_id[20]["near_edited"] > 0.2 > by_id[20]["near_next"]
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def test_span_dedup(docs, rows, nothing):
    got = {r["doc_id"]: r for r in span_dedup.span_dedup(docs.where("doc_id IS NOT NULL")).collect()}
    assert got[3]["n_removed"] == 0 and got[30]["kept_text"] == "" and got[31]["kept_text"] == ""
    assert got[40]["n_removed"] == 0 and got[41]["n_removed"] >= 8
    assert dict(rows)[41].startswith(got[41]["kept_text"][:40])
    assert got[62]["n_removed"] == 0  # a repeated row is the same document
    clean = [k for k in range(24) if k not in (3,)]
    assert all(got[k]["n_removed"] == 0 and got[k]["kept_text"] == dict(rows)[k] for k in clean)
    assert got[50]["kept_text"] == "" and got[52]["kept_text"] == " \n\t "
    assert span_dedup.span_dedup(nothing).count() == 0


def labelled(spark):
    texts = [(k, prose(k, 60) + (" you idiot, pathetic clown" if k % 4 == 0 else "")) for k in range(400)]
    texts += [(1000 + k, " ".join(w + "***" for w in prose(3000 + k, 60).split())) for k in range(120)]
    texts += [(2000, None), (2001, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = [(k, 1, int(k % 4 == 0)) for k in range(400)] + [(1000 + k, 0, 0) for k in range(120)] + [(None, 1, 1), (3, 1, None)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    near = next(r for r in held if r["doc_id"] % 4 == 0)
    assert near["near_labels"] and sorted(near["near_cosines"], reverse=True) == near["near_cosines"]
    unlabelled = toxicity.toxicity(docs, labels.where("false")).collect()
    assert {r["score"] for r in unlabelled} == {0.0}


def test_nearest_is_exact(spark):
    docs, labels = labelled(spark)
    index = toxicity.fit(docs, labels, toxicity.held_out)
    dense = np.zeros((len(index.labels), len(index.terms)))
    for t in range(len(index.terms)):
        for cell in range(t * index.blocks, (t + 1) * index.blocks):
            part = slice(index.starts[cell], index.starts[cell + 1])
            dense[index.examples[part], t] = index.weights[part]
    rng = np.random.default_rng(0)
    for _ in range(50):
        terms = np.sort(rng.choice(len(index.terms), rng.integers(1, len(index.terms) + 1), replace=False))
        query = index.vector(terms, rng.integers(1, 4, len(terms)))
        best, sims = index.nearest(terms, query)
        every = dense[:, terms] @ query
        want = np.sort(every[every > 0])[::-1][: len(sims)]
        assert np.allclose(sims, want) and len(sims) == min(toxicity.NEIGHBOURS, (every > 0).sum())
        assert np.allclose(every[best], sims)


def test_quality(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, labels).collect()}
    assert np.mean([got[k] for k in range(400)]) > 0.97
    assert np.mean([got[1000 + k] for k in range(120)]) < 0.05
    assert not got[2000] and not got[2001]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v}
    assert quality.quality(docs.where("false"), labels).count() == 0
    assert quality.quality(docs, labels.where("false")).where("kept").count() == 520


def test_kth_greatest(spark):
    values = [0.5, 3.0, 3.0, -1e9, 2.25, 1e-9, 7e8]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values) + 1):
        assert quality.kth_greatest(df, "v", k) == sorted(values, reverse=True)[k - 1]
