import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tradewind.llm.common import shared_dir, text_bytes, words
from tradewind.llm.exact_dedup import DigestIndex, exact_dedup
from tradewind.llm.graph import components
from tradewind.llm.near_dedup import near_dedup


def test_exact_dedup(docs, rows, nothing):
    sizes = Counter(t or "" for _, t in rows)
    largest = {}
    for i, t in rows:
        key = t or ""
        largest[key] = max((x for x in (largest.get(key), i) if x is not None), default=None)
    expected = Counter((i, largest[t or ""], sizes[t or ""], i == largest[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter(map(tuple, exact_dedup(docs).collect())) == expected
    assert exact_dedup(nothing).count() == 0


def test_index_is_persistent(spark, docs):
    path = f"{shared_dir(spark)}/kept-index"
    first = exact_dedup(docs.where("doc_id < 30"), DigestIndex(spark, path, 4)).where("kept").count()
    again = DigestIndex(spark, path, 4)  # another session would open it the same way
    rows = {r["doc_id"]: r for r in exact_dedup(docs.where("doc_id BETWEEN 30 AND 41"), again).collect()}
    assert not rows[30]["kept"] and rows[30]["keep_id"] == 3
    assert rows[40]["kept"]
    assert again.rows().count() == first + sum(r["kept"] for r in rows.values())


def shingles(text):
    low = (text or "").translate({65 + k: 97 + k for k in range(26)})
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return frozenset(zip(*[found[k:] for k in range(5)])) if len(found) >= 5 else frozenset([tuple(found)] if found else [])


def brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    real = [(i, s) for i, s in sets if s and i is not None]
    for a, (i, s) in enumerate(real):
        for j, t in real[a + 1 :]:
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def test_near_dedup(docs, rows, nothing):
    assert Counter(map(tuple, near_dedup(docs).collect())) == brute_force(rows)
    assert near_dedup(nothing).count() == 0


def test_near_dedup_of_a_crowd(spark):
    """Many texts around one passage, in more components than the hubs can settle."""
    from texts import prose

    passage = prose(1, 120)
    crowd = [(k, f"{passage} {prose(1000 + k, 6 + k % 40)}") for k in range(120)]
    docs = spark.createDataFrame(crowd, "doc_id long, text string")
    assert Counter(map(tuple, near_dedup(docs).collect())) == brute_force(crowd)


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 5: 5, 9: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabABéあ", max_size=20), max_size=6))
def test_words(texts):
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, docs, hashes = words(data, offsets)
    got = defaultdict(list)
    for a, b, d in zip(starts, ends, docs):
        got[d].append(bytes(data[a:b]).decode())
    expected = {k: w for k, t in enumerate(texts) if (w := [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x])}
    assert got == expected
    flat = [w.translate({65 + k: 97 + k for k in range(26)}) for k in sorted(expected) for w in expected[k]]
    assert len(set(flat)) == len(np.unique(hashes))


def test_lookup_leaves_the_index_in_place(spark, docs):
    """A batch's entries come by a join in which only the batch's groups shuffle."""
    index = DigestIndex(spark, f"{shared_dir(spark)}/still-index", 4)
    exact_dedup(docs, index)
    groups = index.rows().select("digest").limit(5)
    plan = index.lookup(groups)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan, plan
    joined = plan[plan.index("SortMergeJoin"):]
    assert joined.count("hashpartitioning(digest") <= 1, plan
    assert index.lookup(groups).count() == 5
