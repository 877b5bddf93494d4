"""Near-duplicate classes by MinHash with tensored banding, all links verified.

Signatures are two small collections of tuples of minhashes. A table key combines one
tuple of either collection, so TUPLES ** 2 tables need 2 * TUPLES * ROWS minhashes. Rows
with equal shingle sets are one node from the start, so copies are never paired. In each
table cell the members are compared to the cell's hub only; after the links found this way
are contracted, the nodes of cells that still hold several components meet in blocks,
which misses no link between two components. What is joined to cells, tuples and hubs is written
before, so that adaptive execution can split the rows of one that holds many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import mix, passes, runs, signed, staged, text_bytes, words
from tradewind.llm.graph import components

#: Words in a shingle, and the least similarity of a link in hundredths.
WORDS, SIMILAR = 5, 75
#: Tuples in each of the two collections, and minhashes in a tuple. A pair at similarity
#: s shares a cell with probability (1 - (1 - s ** ROWS) ** TUPLES) ** 2: 0.99998 at 0.75.
TUPLES, ROWS = 14, 2
#: Shingles in a block of a cluster whose links the hubs did not settle.
BLOCK = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; its whole word sequence as one
    if it has fewer words than a shingle; empty without words."""
    _, _, docs, hashes = words(data, offsets)
    ends = np.searchsorted(docs, np.arange(len(offsets)))
    grams = runs(hashes, size)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(runs(hashes[a:b], b - a) + np.uint64(b - a) if b > a else hashes[:0])
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n], seeds[n:] | np.uint64(1)


def signatures(docs: DataFrame, tuples: int = TUPLES, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that equal sets share), left and right
    (the two collections of tuples; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xors, factors = _functions(2 * tuples * rows)
        for batch in passes(batches):
            sets = shingle_sets(*text_bytes(batch.column("text")))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            flat = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
            starts = (np.cumsum(sizes) - sizes)[full]
            least = np.zeros((2 * tuples * rows, len(full)), np.uint64)
            ids = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                for k in range(2 * tuples * rows):
                    least[k] = np.minimum.reduceat((flat ^ xors[k]) * factors[k], starts)
                for k in range(2):
                    ids[k, full] = np.add.reduceat(mix(flat * factors[k]), starts)
            packed = np.zeros((2 * tuples, len(full)), np.uint64)
            for k in range(rows):
                packed = mix(packed + least[k::rows])
            halves = []
            for half in (packed[:tuples], packed[tuples:]):
                ends = np.append(0, np.cumsum(np.where(sizes > 0, tuples, 0))).astype(np.int32)
                halves.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.ascontiguousarray(half.T).ravel()))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(signed(ids[0])), pa.array(signed(ids[1])), *halves], ["doc_id", "n_shingles", "set_a", "set_b", "left", "right"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, left array<long>, right array<long>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): the full shingle sets of the documents whose doc_id is in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            sets = [signed(s) for s in shingle_sets(*text_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    wanted = docs.join(ids.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    to = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    every = F.size("x") + F.size("y") - both
    return pairs.join(to, "b").join(of, "a").where(100 * both >= similar * every).select("a", "b")


def near_dedup(docs: DataFrame, similar: int = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Null, empty and all-space texts have an empty set and are linked with nothing. Rows
    with one doc_id are one document. Rows with a null id are linked with nothing, their
    component is null and they are kept. Empty input gives no rows. Other columns of docs
    are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = staged(signatures(docs), "signatures")
    real = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    nodes = staged(nodes, "nodes")
    links = _links(docs, nodes, similar)
    found = components(links)
    named = nodes.join(found, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    named = named.withColumn("_full", F.lit(True))
    out = rows.withColumn("_full", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(named, ["set_a", "set_b", "_full"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _links(docs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """Confirmed links (a, b) that connect all nodes which share a cell and are similar."""
    tuples = nodes.select("id", F.size("left").alias("_half"), F.posexplode(F.concat("left", "right")).alias("_k", "_x"))
    tuples = tuples.select("id", (F.col("_k") < F.col("_half")).alias("_left"), F.xxhash64("_k", "_x").alias("_tuple"))
    # A tuple that one node alone has makes no shared cell; few tuples are left.
    live = tuples.groupBy("_tuple").agg(F.min("id").alias("_p"), F.max("id").alias("_q")).where("_p < _q").select("_tuple")
    live = staged(tuples.join(staged(live, "live"), "_tuple"), "tuples")
    left, right = (live.where(side).select("id", F.col("_tuple").alias(name)) for side, name in (("_left", "_x"), ("NOT _left", "_y")))
    cells = staged(left.join(right, "id").select(F.xxhash64("_x", "_y").alias("cell"), "id"), "cells")
    hubs = cells.groupBy("cell").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).where("hub < _last").drop("_last")
    shared = staged(cells.join(staged(hubs, "hubs"), "cell"), "shared")
    pairs = staged(shared.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sets = staged(full_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), "sets")
    links = staged(confirmed(pairs, sets, similar), "links")
    found = staged(components(links), "found")
    cells = shared.select("cell", "id").join(found, "id", "left").select("cell", "id", F.coalesce("component", "id").alias("component"))
    cells = staged(cells, "open")
    mixed = cells.groupBy("cell").agg(F.min("component").alias("hub"), F.max("component").alias("_last")).where("hub < _last").drop("_last")
    cells = staged(cells.join(staged(mixed, "joint"), "cell").select("id", "component", "hub").distinct(), "mixed")
    clusters = components(cells.select(F.col("hub").alias("a"), F.col("component").alias("b")))
    clusters = clusters.select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    left = cells.select("id", "component").distinct().join(clusters, "component")
    return links.union(_rest(sets.join(left, "id"), similar))


def _rest(sets: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) between components of one cluster, without loss; a few for each two.

    Sets come as (id, shingles, component, cluster). A cluster is cut into blocks of a
    bounded number of shingles, each two blocks meet in one task, and small clusters share
    tasks. No pair is a row: a task counts common shingles in arrays.
    """
    sets = staged(sets.withColumn("n", F.size("shingles").cast("long")), "rest")
    sizes = sets.groupBy("cluster").agg(F.sum("n").alias("weight"))
    sizes = staged(sizes, "sizes")
    small = sizes.where(F.col("weight") <= BLOCK).agg(F.sum("weight")).first()[0] or 0
    shares = max(1, -(-small // BLOCK))
    sized = sets.join(sizes, "cluster").withColumn("_blocks", F.ceil(F.col("weight") / BLOCK))
    own = F.pmod(F.xxhash64("id"), "_blocks")
    sized = sized.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    alone = F.col("_blocks") == 1
    keyed = sized.select(
        F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(shares))).otherwise(F.col("cluster")).alias("group"),
        alone.alias("alone"),
        F.least("_own", "_other").alias("i"),
        F.greatest("_own", "_other").alias("j"),
        "id",
        "component",
        "shingles",
    )
    return keyed.groupBy("group", "alone", "i", "j").applyInArrow(_cross_links(similar), "a long, b long")


def _cross_links(similar: int):
    def run(table: pa.Table) -> pa.Table:
        ids, comps = table["id"].to_numpy(), table["component"].to_numpy()
        column = table["shingles"].combine_chunks()
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, terms = np.unique(column.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        posted = owner[order]  # rows by term
        first = np.append(0, np.cumsum(np.bincount(terms)))
        kinds, which, many = np.unique(comps, return_inverse=True, return_counts=True)
        starts = np.append(0, np.cumsum(sizes))
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for a in np.flatnonzero(which != many.argmax()).tolist():
            own = terms[starts[a] : starts[a + 1]]
            low, count = first[own], first[own + 1] - first[own]
            ends = np.cumsum(count)
            rows = posted[np.repeat(low - (ends - count), count) + np.arange(ends[-1])]
            both = np.bincount(rows, minlength=len(ids))
            near = np.flatnonzero((100 * both >= similar * (sizes[a] + sizes - both)) & (which != which[a]))
            for b in near.tolist():
                key = (min(which[a], which[b]), max(which[a], which[b]))
                out.setdefault(key, (min(ids[a], ids[b]), max(ids[a], ids[b])))
        found = np.array(list(out.values()), np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


#: All pairs that share a shingle, in SQL; for small tables.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), k AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(list_sort(shingles), chr(10))) AS same FROM s),
n AS (SELECT same, min(doc_id) AS id, any_value(n) AS n FROM k WHERE n > 0 GROUP BY same),
e AS (SELECT id, n, unnest(shingles) AS x FROM n JOIN s ON s.doc_id = n.id),
p AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
c AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT k.doc_id, k.n AS n_shingles, coalesce(c.component, n.id, k.doc_id) AS component_id, k.doc_id = coalesce(c.component, n.id, k.doc_id) AS kept
FROM k LEFT JOIN n ON n.same = k.same AND k.n > 0 LEFT JOIN c ON c.id = n.id
"""
