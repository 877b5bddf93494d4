"""The manifest against a tree built by hand, and proofs against the root."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tradewind.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def reduce(nodes):
    """(root, path of (left, right) for each node)"""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p - p % 3
            paths[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def by_hand(rows):
    """Multiset of (doc_id, leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        text = row[4]
        if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups.setdefault(row[1], []).append((row[0], leaf_of(*row), leaf_of(*row[:4], text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    below = {name: reduce([r[1] for r in groups[name]]) for name in names}
    root, above = reduce([below[name][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for (doc, leaf, checked), path in zip(groups[name], below[name][1]):
            steps, node = path + above[k], checked
            for left, right in steps:
                node = h(left, node, right)
            out.append((doc, leaf, below[name][0], root, h(*(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def proofs(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name, value in more.items():
        frame = frame.withColumn(name, F.lit(value))
    return sorted(map(tuple, merkle.document_proofs(frame).collect()), key=str)


def test_documents_equal_a_tree_by_hand(spark):
    r = random.Random(1)
    rows = [(k * r.choice([1, 7]) - 40, r.choice(["hot", "hot", "b", "é", "", None]), "en", k, f"line {k}\nnext") for k in range(900)]
    rows += [(2**62 + k * 2**40, "far", None, None, None) for k in range(20)] + [(-(2**63), "far", "x", 1, "a"), (2**63 - 1, "far", "x", 1, "a")]
    rows += [(None, "b", None, None, None), (None, "b", "en", 3, "t\n"), (None, None, None, None, None), (1, "one", "en", 1, "x" * 300_000 + "\n")]
    rows += [(5, "copies", "en", 2, "same\n")] * 40 + [(5, "copies", "en", 2, f"other {k}") for k in range(40)]
    got = proofs(spark, rows, rank=9, digest="z", path=3, block=1, held="h", _p="x")
    expected = by_hand(rows)
    assert len(got) == len(rows)
    # Equal rows hold places of their own, in any order.
    assert got == expected
    assert any(not row[-1] for row in got) and any(row[-1] for row in got)


def test_a_lone_row_is_its_own_root(spark):
    ((doc, leaf, subroot, root, proof, folded, verified),) = proofs(spark, [(3, "s", "en", 1, "x")])
    assert leaf == subroot == root == folded and verified and proof == h()


def test_many_groups(spark):
    rows = [(k, f"host {k % 400}", "en", 1, f"{k}") for k in range(700)]
    assert proofs(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    assert proofs(spark, []) == []
