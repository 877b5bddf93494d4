"""Merkle manifest of a dataset: a digest for each group of rows and one for all, with proofs.

Rows are ranked in their group without a global sort. The sort key (the id's 64 bits, then
the first 16 bits of the leaf) is read as digits; a histogram for each prefix counts the
rows under every next digit, and a row's rank is the sum, over its digits, of the rows under
smaller ones. Histograms are partial aggregates, and no window is wider than one digit.
Written in the base of the tree's fanout, a rank is a path in a trie: the rows that share
all but the last digits are the leaves under one node, so a shuffle on that prefix reduces
LEVELS levels of the tree at once, and proofs go back down by the same prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import staged
from tradewind.llm.sql import CRC_TABLE, crc32_sql

FANOUT = 3
#: Levels of the tree that one shuffle reduces: FANOUT ** LEVELS nodes meet in a group.
LEVELS = 5
#: Bits of each digit of the sort key, from the top; 64 of the id and 16 of the leaf.
DIGITS = (14, 14, 14, 14, 8, 16)


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as `-` if null, else its UTF-8 byte count, `:` and value."""
    texts = [c.cast("string") for c in fields]
    return hashed(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts))


def _prefix(level: int) -> Column:
    """The first digits, down to `level`, of the sort key in the columns _id and leaf."""
    if level == len(DIGITS):
        return F.struct(F.col("_id").alias("id"), F.substring("leaf", 1, DIGITS[-1] // 4).alias("leaf"))
    return F.struct(F.shiftright("_id", 64 - sum(DIGITS[:level])).alias("id"), F.lit("").alias("leaf"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (_group, _id long, leaf, other columns of equal value for equal rows) with rank
    (from 0, by _id, nulls first, then leaf) and n, the size of the group.

    Equal rows are counted first and numbered apart last, so that no task sorts them.
    """
    keys = ["_group", "_id", "leaf"]
    others = [F.first(c).alias(c) for c in rows.columns if c not in keys]
    distinct = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), *others), "leaves")
    depth = len(DIGITS)
    digits = [F.struct(F.col("_id").isNotNull().alias("known"), _prefix(k).alias("digits")) for k in range(1, depth + 1)]
    counts = {depth: distinct.groupBy("_group", *(d.alias(f"_p{k}") for k, d in enumerate(digits, 1))).agg(F.sum("_copies").alias("_rows"))}
    for k in range(depth, 1, -1):
        counts[k] = staged(counts[k], "digits")
        counts[k - 1] = counts[k].groupBy("_group", *(f"_p{j}" for j in range(1, k))).agg(F.sum("_rows").alias("_rows"))
    offsets = counts[1].groupBy("_group").agg(F.sum("_rows").alias("n")).withColumn("_before", F.lit(0).cast("long"))
    for k in range(1, depth + 1):
        parent = [f"_p{k - 1}"] if k > 1 else []
        smaller = Window.partitionBy("_group", *parent).orderBy(f"_p{k}").rowsBetween(Window.unboundedPreceding, -1)
        inside = counts[k].select("_group", *parent, f"_p{k}", F.coalesce(F.sum("_rows").over(smaller), F.lit(0)).alias("_smaller"))
        same = inside["_group"].eqNullSafe(offsets["_group"])
        for c in parent:
            same = same & (inside[c] == offsets[c])
        offsets = inside.join(offsets, same).select(inside["_group"], f"_p{k}", (F.col("_before") + F.col("_smaller")).alias("_before"), "n")
    last = f"_p{depth}"
    offsets = offsets.select(F.col("_group").alias("_g"), F.col(last).alias("_p"), "_before", "n")
    placed = distinct.withColumn("_p", digits[-1])
    placed = placed.join(offsets, placed["_group"].eqNullSafe(offsets["_g"]) & (placed["_p"] == offsets["_p"])).drop(offsets["_p"])
    ties = Window.partitionBy("_group", "_p").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_copies").over(ties), F.lit(0))
    return (
        placed.withColumn("_first", first)
        .withColumn("rank", F.explode(F.sequence("_first", F.col("_first") + F.col("_copies") - 1)))
        .drop("_p", "_g", "_before", "_first", "_copies")
    )


def _levels(n: Column) -> Column:
    """Levels of a tree over n leaves: the least L with FANOUT ** L >= n."""
    powers = F.array(*(F.lit(FANOUT**k) for k in range(40)))
    return F.size(F.filter(powers, lambda p: p < n))


def tree(leaves: DataFrame) -> DataFrame:
    """leaves (_group, rank, n, digest, other columns) with the group's root and the path to it.

    Ranks are 0 to n - 1 in each group. path is an array of (left, right), the digests beside
    the node on each level, in order and concatenated, from the leaf up. Each pass reduces
    LEVELS levels; as many passes run as the largest group needs.
    """
    others = [c for c in leaves.columns if c not in ("_group", "rank", "n", "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 1
    nodes = leaves.select("_group", "rank", "n", "digest", F.struct(F.lit(None).alias("_"), *others).alias("held"))
    passes, done = [], 0
    while not passes or FANOUT**done < most:
        rest = F.greatest(_levels(F.col("n")) - done, F.lit(0))
        rows = nodes.groupBy("_group", F.expr(f"rank div {FANOUT**LEVELS}").alias("block"), "n").agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest", *(["held"] if not passes else [])))).alias("nodes")
        )
        rows = rows.withColumn("h0", F.col("nodes.digest"))
        for k in range(LEVELS):
            rows = rows.withColumn(f"h{k + 1}", F.when(rest > k, _reduced(f"h{k}")).otherwise(F.col(f"h{k}")))
        kept = ["_group", "block", "n", F.least(rest, F.lit(LEVELS)).alias("rest"), *(f"h{k}" for k in range(LEVELS + 1))]
        passes.append(staged(rows.select(*kept, *([F.col("nodes.held").alias("held")] if not passes else [])), "tree"))
        nodes = passes[-1].select("_group", F.col("block").alias("rank"), "n", F.col(f"h{LEVELS}")[0].alias("digest"))
        done += LEVELS
    none = F.array().cast("array<struct<left:string,right:string>>")
    paths = nodes.select(F.col("_group").alias("_g"), F.col("rank").alias("_b"), F.col("digest").alias("root"), none.alias("_above"))
    for k, blocks in reversed(list(enumerate(passes))):
        under = blocks.join(paths, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
        under = under.select("_group", "block", "n", "root", "_above", *([] if k else ["held"]), "h0", F.explode(_beside()).alias("s"))
        place = F.col("block") * FANOUT**LEVELS + F.col("s.at")
        path = F.concat("s.path", "_above")
        if k:
            paths = under.select(F.col("_group").alias("_g"), place.alias("_b"), "root", path.alias("_above"))
    return under.select("_group", place.alias("rank"), "n", F.col("h0")[F.col("s.at")].alias("digest"), *(F.col("held")[F.col("s.at")][c].alias(c) for c in others), "root", path.alias("path"))


def _reduced(nodes: str) -> Column:
    """The next level: each run of FANOUT digests becomes its digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(F.col(nodes), i * FANOUT + 1, F.lit(FANOUT)), "").cast("binary"), 256))


def _beside() -> Column:
    """(at, path) for each node of h0: the digests beside it and the nodes above it."""

    def siblings(at: Column, level: int) -> Column:
        nodes, place = F.col(f"h{level}"), F.floor(at / FANOUT**level).cast("int")
        run = place - place % FANOUT
        left, right = F.slice(nodes, run + 1, place - run), F.slice(nodes, place + 2, run + FANOUT - place - 1)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    def each(at: Column) -> Column:
        return F.struct(at.alias("at"), F.slice(F.array(*(siblings(at, k) for k in range(LEVELS))), F.lit(1), F.col("rest")).alias("path"))

    return F.transform(F.sequence(F.lit(0), F.size("h0") - 1), each)


def folded(digest: str, path: str) -> Column:
    """The root that follows from a leaf and the digests beside its path."""
    return F.aggregate(path, F.col(digest), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def manifest(rows: DataFrame, group: str, order: str, fields: list[Column], checked: list[Column] | None = None) -> DataFrame:
    """Leaves, group roots, the dataset root and a proof for each row.

    The rows of a group ascend by `order` (a whole number, nulls first; rows with equal
    numbers by their leaf). While a level has several nodes, each run of FANOUT becomes its
    digest, the last run with fewer, even one. The roots of the groups, in UTF-8 order of
    the group's name with the null group first, are reduced likewise. `checked` are the
    fields as another copy holds them (default: the same): the root is recomputed from
    their leaf and the original siblings. Equal rows get places side by side. Empty input
    gives no rows; other columns are not read.

    Returns group, order, leaf, subroot, root, path (array of left, right), checked_leaf.
    """
    leaves = rows.select(
        F.col(group).cast("string").alias("_group"),
        F.col(order).cast("long").alias("_id"),
        leaf(fields).alias("leaf"),
        leaf(checked or fields).alias("checked_leaf"),
    )
    placed = ranked(leaves).withColumnRenamed("leaf", "digest")
    below = staged(tree(staged(placed, "ranks")).withColumnRenamed("root", "subroot"), "proofs")
    # The groups may be many: their names are numbered in cuts of their order, one for each partition.
    names = below.where("rank = 0").select(F.col("_group").alias("name"), F.col("subroot").alias("digest"))
    cuts = staged(names.repartitionByRange(F.col("name").asc_nulls_first()).withColumn("_cut", F.spark_partition_id()), "names")
    inside = F.row_number().over(Window.partitionBy("_cut").orderBy(F.col("name").asc_nulls_first())) - 1
    sizes = cuts.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n"))
    tops = cuts.withColumn("_in", inside).join(starts, "_cut").select(F.lit("").alias("_group"), (F.col("_in") + F.col("_start")).alias("rank"), "n", "digest", "name")
    above = tree(staged(tops, "subroots")).select("name", "root", F.col("path").alias("_above"))
    joined = below.join(above, below["_group"].eqNullSafe(above["name"]))
    return joined.select(
        F.col("_group").alias("group"),
        F.col("_id").alias("order"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.concat("path", "_above").alias("path"),
        "checked_leaf",
    )


def document_proofs(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source, with each proof's digest and tampered texts checked.

    Where 2 divides the CRC-32 of the decimal doc_id, the checked text lacks its line
    feeds; null ids and texts are not tampered with. Nulls, repeated rows and empty input
    as in `manifest`.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = manifest(docs, "source", "doc_id", [*before, F.col("text")], [*before, tampered])
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = rows.select(
        F.col("order").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded("checked_leaf", "path").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT {CRC_TABLE} AS crc_table
), rows AS (
  SELECT *, row_number() OVER () AS id, coalesce({crc32_sql("doc_id::VARCHAR")} % 2 = 0, false) AS tampered
  FROM documents, crc_table
), prefixed AS (
  SELECT id, doc_id, source, text, tampered,
         concat({", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))}) AS head
  FROM rows
), leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END) || ':'
                                 || CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END, '-')) AS checked
  FROM prefixed
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), below AS (
  SELECT source, 0 AS level, rank AS place, n AS width, leaf AS digest FROM ranks
  UNION ALL
  SELECT source, level + 1, place // 3, any_value((width + 2) // 3), sha256(string_agg(digest, '' ORDER BY place))
  FROM below WHERE width > 1 GROUP BY source, level, place // 3
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS width
  FROM below WHERE width = 1
), above AS (
  SELECT 0 AS level, place, width, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, any_value((width + 2) // 3), sha256(string_agg(digest, '' ORDER BY place))
  FROM above WHERE width > 1 GROUP BY level, place // 3
), steps AS (
  SELECT r.id, b.level, b.place < r.rank // (3 ** b.level)::BIGINT AS is_left, b.place, b.digest
  FROM ranks r JOIN below b ON b.source IS NOT DISTINCT FROM r.source AND b.width > 1
    AND b.place // 3 = r.rank // (3 ** (b.level + 1))::BIGINT AND b.place <> r.rank // (3 ** b.level)::BIGINT
  UNION ALL
  SELECT r.id, 100 + a.level, a.place < s.place // (3 ** a.level)::BIGINT, a.place, a.digest
  FROM ranks r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source
  JOIN above a ON a.width > 1 AND a.place // 3 = s.place // (3 ** (a.level + 1))::BIGINT AND a.place <> s.place // (3 ** a.level)::BIGINT
), every_level AS (
  SELECT DISTINCT r.id, b.level FROM ranks r JOIN below b ON b.source IS NOT DISTINCT FROM r.source AND b.width > 1
  UNION ALL
  SELECT DISTINCT r.id, 100 + a.level FROM ranks r, above a WHERE a.width > 1
), paths AS (
  SELECT e.id, e.level, row_number() OVER (PARTITION BY e.id ORDER BY e.level) AS step,
         coalesce(string_agg(digest, '' ORDER BY place) FILTER (is_left), '') AS lefts,
         coalesce(string_agg(digest, '' ORDER BY place) FILTER (NOT is_left), '') AS rights
  FROM every_level e LEFT JOIN steps s ON s.id = e.id AND s.level = e.level
  GROUP BY e.id, e.level
), folds AS (
  SELECT id, 0 AS step, checked AS digest FROM ranks
  UNION ALL
  SELECT f.id, f.step + 1, sha256(p.lefts || f.digest || p.rights) FROM folds f JOIN paths p ON p.id = f.id AND p.step = f.step + 1
)
SELECT r.doc_id, r.leaf, s.subroot, t.digest AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = t.digest AS verified
FROM ranks r
JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source
JOIN (SELECT digest FROM above WHERE width = 1) t ON true
LEFT JOIN (SELECT id, string_agg(lefts || rights, '' ORDER BY step) AS proof, max(step) AS steps FROM paths GROUP BY id) q ON q.id = r.id
JOIN folds f ON f.id = r.id AND f.step = coalesce(q.steps, 0)
"""
