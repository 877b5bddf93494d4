"""Structure repair of conversations by weighted finite-state composition.

Three machines are composed: an acceptor of a conversation's turns, a transducer of edits
(keep, give another role, delete, insert) and an acceptor of the role grammar
`(s?(ua)+)?`. The edit transducer has one state, so a state of the composition is a place
between two turns and a grammar state; its arcs are made when the search asks for them.
Weights are (cost, edit labels), compared by cost and then by label string. Of two label
strings of one cost over the same turns neither begins the other, so the order survives
concatenation on both sides and weights can be multiplied in any grouping.

That grouping is what makes a conversation of any length fit: its turns are cut into
chunks, each chunk becomes a matrix of weights from grammar state to grammar state by a
shortest path in reverse topological order, and the matrices of a conversation are
multiplied from its end as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import staged
from tradewind.llm.sql import CRC_TABLE, crc32_sql

#: Turns of a chunk, and characters at which a chunk ends early.
TURNS = 256
CHARS = 1 << 20

#: Grammar states: nothing yet, after system, after user, after assistant. The first and the last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPTING = (START, ASSISTANT)
GRAMMAR = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
#: The role that may be given or inserted in a state, by its initial.
EXPECTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}

RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

WHITE = " \t\n\v\f\r"

Weight = tuple[int, str]


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the faults that crc32 of `conv_id:turn` modulo 20 deals out.

    0 drops a row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 sets the
    role user. Nulls in any column count as one space here. A dropped row stays with
    `copies` 0, so that its conversation is known; a repeated one has `copies` 2.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn, role, text)]
    draw = F.crc32(F.concat_ws(":", filled[0], filled[1]).cast("binary")) % 20
    return rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(filled[2]).alias("role"),
        F.when(draw.isin(0, 1), "").when(draw == 2, F.translate(filled[3], ".!?", "")).otherwise(filled[3]).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation, one row for each edit.

    rows: conv_id (any type), turn, role, text and, if given, `copies` (how often the row
    stands there, 0 or more); other columns are not read. Turns are ordered by turn, nulls
    first, rows of one turn by the SHA-256 of role and text; a null conv_id is a
    conversation like any other, null roles and texts count as one space. Returns conv_id,
    step (from 0), edit (K, R, D, I), turn (null for I), role and text as they are after
    the edit (null for D). Conversations without turns have no row. Empty input gives none.
    """
    chunks, plans = _solved(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _walked(chunks, plans, _edits, f"conv_id {kind}, step long, edit string, turn long, role string, text string")


def audit(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `rows` (as in `repair`, with the same rules).

    gaps (missing whole numbers between least and greatest turn, nulls ignored), blank,
    duplicate, truncated (turns by their first fault), illegal (neighbours whose role
    initials are not su, ua or au), cost and audit (labels of the cheapest edits),
    repaired_sha256 (of `role:text` lines). A conversation whose rows all have no copies
    gives zeros, an empty audit and the digest of the empty string.
    """
    chunks, plans = _solved(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _walked(
        chunks,
        plans,
        _summaries,
        f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )


def _solved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of turns, and for each conversation its cost, edit labels and faults."""
    chunks = staged(_chunks(rows), "turns")
    first = (
        chunks.select("conv_id", "part", "chunk", F.posexplode("digests").alias("at", "digest"))
        .groupBy("conv_id", "digest")
        .agg(F.min(F.struct("part", "chunk", "at")).alias("first"))
        .select("first.*")
        .groupBy("part", "chunk")
        .agg(F.collect_list("at").alias("firsts"))
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    weighed = (
        chunks.select("conv_id", "part", "chunk", "marks")
        .join(first, ["part", "chunk"], "left")
        .mapInArrow(_weighed, f"conv_id {kind}, part int, chunk long, faults string, costs array<int>, labels array<string>")
    )
    plans = (
        weighed.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
        .mapInArrow(_multiplied, f"conv_id {kind}, faults string, cost long, audit string")
    )
    return chunks, plans


def _chunks(rows: DataFrame) -> DataFrame:
    """Turns in order, at most TURNS of one conversation in a row; (part, chunk) gives their order.

    Range partitioning by conversation, turn, content and place spreads a conversation that
    holds much of the input, and even a turn that does.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    listed = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.col("copies") if "copies" in rows.columns else F.lit(1)).cast("int").alias("copies"),
        F.monotonically_increasing_id().alias("place"),
    )
    marked = listed.select(
        "*",
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
        F.concat(
            F.when(solid == "", "b").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "t").otherwise("."),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("-"),
        ).alias("mark"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "place"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    return dealt.mapInArrow(
        _packed,
        f"conv_id {kind}, part int, chunk long, turns array<long>, roles array<string>, texts array<string>, digests array<binary>, marks array<string>",
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, chunk, size, open_id = TaskContext.get().partitionId(), 0, 0, ()
    held: list[tuple] = []
    kind = pa.int64()

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*held)) if held else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
        lists = [pa.array([list(c)], pa.list_(k)) for c, k in zip(columns, kinds)]
        head = [pa.array([open_id[0]], kind), pa.array([part], pa.int32()), pa.array([chunk], pa.int64())]
        return pa.record_batch(head + lists, ["conv_id", "part", "chunk", "turns", "roles", "texts", "digests", "marks"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        ids, turns, roles, texts, copies, digests, marks = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "digest", "mark"))
        for k, conv in enumerate(ids):
            if open_id and (conv != open_id[0] or len(held) >= TURNS or size >= CHARS):
                yield flushed()
                held, size, chunk = [], 0, chunk + 1
            open_id = (conv,)
            for _ in range(copies[k]):
                held.append((turns[k], roles[k], texts[k], digests[k], marks[k]))
                size += len(texts[k])
    if open_id:
        yield flushed()


def arcs(turn: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, label, next state) of the composition's arcs that read this turn in `state`.

    A turn is `D` if it must be deleted, else its fault (`t` truncated, `.` none) and the
    initial of its role.
    """
    yield DELETE, "D", state
    if turn != "D":
        extra = TRUNCATED if turn[0] == "t" else 0
        if (state, turn[1]) in GRAMMAR:
            yield extra, "K", GRAMMAR[state, turn[1]]
        given = EXPECTED[state]
        if given != turn[1]:
            yield RENAME + extra, "R", GRAMMAR[state, given]


def with_insertions(best: dict[int, dict[int, Weight]]) -> dict[int, dict[int, Weight]]:
    """best, where any state may first take insertion arcs. Each costs something, and the
    grammar returns to a state after two, so two insertions at most begin a cheapest path."""
    out = best
    for _ in range(2):
        out = {q: _least(best[q], _after(INSERT, "I", out[GRAMMAR[q, EXPECTED[q]]])) for q in STATES}
    return out


def _after(cost: int, label: str, weights: dict[int, Weight]) -> dict[int, Weight]:
    return {r: (cost + c, label + s) for r, (c, s) in weights.items()}


def _least(*options: dict[int, Weight]) -> dict[int, Weight]:
    out: dict[int, Weight] = {}
    for option in options:
        for r, w in option.items():
            if r not in out or w < out[r]:
                out[r] = w
    return out


@lru_cache(maxsize=4096)
def matrix(turns: tuple[str, ...]) -> dict[int, dict[int, Weight]]:
    """Least weight from each state before the turns to each state after them."""
    best: dict[int, dict[int, Weight]] = {q: {q: (0, "")} for q in STATES}
    for turn in reversed(turns):
        best = with_insertions({q: _least(*(_after(c, label, best[to]) for c, label, to in arcs(turn, q))) for q in STATES})
    return best


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        faults, costs, labels = [], [], []
        for marks, firsts in zip(batch.column("marks").to_pylist(), batch.column("firsts").to_pylist()):
            known = set(firsts or ())
            seen = [m[0] if m[0] == "b" or k in known else "d" for k, m in enumerate(marks)]
            weights = matrix(tuple("D" if f in "bd" else f + m[1] for f, m in zip(seen, marks)))
            flat = [weights[q].get(r) for q in STATES for r in STATES]
            faults.append("".join(seen))
            costs.append([w and w[0] for w in flat])
            labels.append([w and w[1] for w in flat])
        head = [batch.column(c) for c in ("conv_id", "part", "chunk")]
        tail = [pa.array(faults, pa.string()), pa.array(costs, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.string()))]
        yield pa.record_batch(head + tail, ["conv_id", "part", "chunk", "faults", "costs", "labels"])


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from a conversation's last to its first: only the weights to the end are held."""
    end = with_insertions({q: {0: (0, "")} if q in ACCEPTING else {} for q in STATES})
    open_id, best, faults = (), end, []

    def closed(kind: pa.DataType) -> pa.RecordBatch:
        cost, labels = best[START][0]
        values = ((open_id[0], kind), ("".join(reversed(faults)), pa.string()), (cost, pa.int64()), (labels, pa.string()))
        return pa.record_batch([pa.array([v], t) for v, t in values], ["conv_id", "faults", "cost", "audit"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, fault, costs, labels in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "faults", "costs", "labels"))):
            if open_id and conv != open_id[0]:
                yield closed(kind)
                best, faults = end, []
            open_id = (conv,)
            faults.append(fault)
            best = {
                q: _least(*(_after(costs[4 * q + r], labels[4 * q + r], best[r]) for r in STATES if costs[4 * q + r] is not None and best[r]))
                for q in STATES
            }
    if open_id:
        yield closed(kind)


def _walked(chunks: DataFrame, plans: DataFrame, walk, schema: str) -> DataFrame:
    """Each conversation's plan, then its chunks in order, through `walk`. A digest over a
    whole conversation is sequential, so one task reads its chunks, one at a time."""
    none = F.lit(None)
    heads = plans.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("chunk"), "faults", "cost", "audit", *(none.cast(t).alias(c) for c, t in (("turns", "array<long>"), ("roles", "array<string>"), ("texts", "array<string>"))))
    bodies = chunks.select("conv_id", "part", "chunk", none.cast("string").alias("faults"), none.cast("long").alias("cost"), none.cast("string").alias("audit"), "turns", "roles", "texts")
    return heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(walk, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, its Arrow type, plan or None, turns) for each plan and chunk, in order."""
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for k in range(batch.num_rows):
            conv = batch.column("conv_id")[k].as_py()
            if batch.column("part")[k].as_py() < 0:
                yield conv, kind, tuple(batch.column(c)[k].as_py() for c in ("faults", "cost", "audit")), ()
            else:
                yield conv, kind, None, list(zip(*(batch.column(c)[k].as_py() for c in ("turns", "roles", "texts"))))


class _Replay:
    """Applies an audit to turns as they come."""

    def __init__(self, labels: str):
        self.labels, self.at, self.state = labels, 0, START

    def _given(self) -> str:
        initial = EXPECTED[self.state]
        self.state = GRAMMAR[self.state, initial]
        return ROLES[initial]

    def inserted(self) -> Iterator[tuple]:
        """The insertions that stand next."""
        while self.at < len(self.labels) and self.labels[self.at] == "I":
            self.at += 1
            yield self.at - 1, "I", None, self._given(), ""

    def edits(self, turns: list[tuple]) -> Iterator[tuple]:
        """(step, edit, turn, role, text)"""
        for turn, role, text in turns:
            yield from self.inserted()
            label, self.at = self.labels[self.at], self.at + 1
            if label == "K":
                self.state = GRAMMAR[self.state, role[:1]]
            elif label == "R":
                role = self._given()
            yield (self.at - 1, label, turn, None, None) if label == "D" else (self.at - 1, label, turn, role, text)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "step", "edit", "turn", "role", "text"]

    def table(conv, kind, edits: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([pa.array([conv] * len(edits), kind)] + [pa.array(c, t) for c, t in zip(zip(*edits), kinds)], names)

    replay, last = None, None
    for conv, kind, plan, turns in _conversations(batches):
        if plan:
            if replay and (left := list(replay.inserted())):
                yield table(*last, left)
            replay, last = _Replay(plan[2]), (conv, kind)
        elif edits := list(replay.edits(turns)):
            yield table(conv, kind, edits)
    if replay and (left := list(replay.inserted())):
        yield table(*last, left)


class _Summary:
    def __init__(self, conv, plan: tuple):
        self.conv, (self.faults, self.cost, self.labels) = conv, plan
        self.replay, self.digest, self.lines = _Replay(self.labels), hashlib.sha256(), 0
        self.low = self.high = self.initial = None
        self.distinct = self.illegal = 0

    def read(self, turns: list[tuple]) -> None:
        for turn, role, _ in turns:
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self._add(self.replay.edits(turns))

    def _add(self, edits: Iterator[tuple]) -> None:
        lines = [f"{role}:{text}" for _, label, _, role, text in edits if label != "D"]
        if lines:
            self.digest.update((("\n" if self.lines else "") + "\n".join(lines)).encode())
            self.lines += len(lines)

    def row(self) -> tuple:
        self._add(self.replay.inserted())
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, *(self.faults.count(f) for f in "bdt"), self.illegal, self.cost, self.labels, self.digest.hexdigest())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    summary, done, kind = None, [], pa.int64()

    def table() -> pa.RecordBatch:
        kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    for conv, kind, plan, turns in _conversations(batches):
        if plan:
            if summary:
                done.append(summary.row())
            summary = _Summary(conv, plan)
            if len(done) >= 1000:
                yield table()
                done = []
        else:
            summary.read(turns)
    if summary:
        done.append(summary.row())
        yield table()


ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT {CRC_TABLE} AS crc_table
), source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), drawn AS (
  SELECT *, {crc32_sql("key")} % 20 AS draw FROM source, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, LATERAL (SELECT unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, left(role, 1) AS initial
  FROM damaged
), faulty AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair,
         CASE WHEN solid = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
), solved AS (
  -- least (cost, labels) from the turns after place pos to the end, by grammar state: n nothing yet, s, u, a
  SELECT conv_id, n AS pos, {{'c': 0, 'l': ''}} AS wn, {{'c': 6, 'l': 'II'}} AS ws, {{'c': 3, 'l': 'I'}} AS wu, {{'c': 0, 'l': ''}} AS wa
  FROM counted
  UNION ALL
  SELECT conv_id, pos - 1,
         list_min([rn, {{'c': ru.c + 3, 'l': 'I' || ru.l}}, {{'c': ra.c + 6, 'l': 'II' || ra.l}}]),
         list_min([rs, {{'c': ru.c + 3, 'l': 'I' || ru.l}}, {{'c': ra.c + 6, 'l': 'II' || ra.l}}]),
         list_min([ru, {{'c': ra.c + 3, 'l': 'I' || ra.l}}]),
         list_min([ra, {{'c': ru.c + 3, 'l': 'I' || ru.l}}])
  FROM (
    SELECT s.conv_id, s.pos,
           list_min([{{'c': wn.c + 4, 'l': 'D' || wn.l}}, {{'c': CASE WHEN gone THEN 1000000000 WHEN initial = 's' THEN ws.c + more ELSE 1000000000 END, 'l': 'K' || ws.l}},
             {{'c': CASE WHEN gone THEN 1000000000 WHEN initial = 'u' THEN wu.c + more ELSE wu.c + 3 + more END, 'l': CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END || wu.l}}]) AS rn,
           list_min([{{'c': ws.c + 4, 'l': 'D' || ws.l}},
             {{'c': CASE WHEN gone THEN 1000000000 WHEN initial = 'u' THEN wu.c + more ELSE wu.c + 3 + more END, 'l': CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END || wu.l}}]) AS rs,
           list_min([{{'c': wu.c + 4, 'l': 'D' || wu.l}},
             {{'c': CASE WHEN gone THEN 1000000000 WHEN initial = 'a' THEN wa.c + more ELSE wa.c + 3 + more END, 'l': CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END || wa.l}}]) AS ru,
           list_min([{{'c': wa.c + 4, 'l': 'D' || wa.l}},
             {{'c': CASE WHEN gone THEN 1000000000 WHEN initial = 'u' THEN wu.c + more ELSE wu.c + 3 + more END, 'l': CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END || wu.l}}]) AS ra
    FROM solved s JOIN (
      SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faulty
    ) f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos
  )
), audits AS (
  SELECT conv_id, wn.c AS cost, wn.l AS audit FROM solved WHERE pos = 0
), edits AS (
  SELECT conv_id, audit, p, audit[p] AS label,
         p - length(replace(left(audit, p), 'I', '')) AS inserted, length(replace(left(audit, p), 'D', '')) AS line
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)
), lines AS (
  SELECT e.conv_id, e.p, e.line, e.label, f.role, f.text,
         max(CASE WHEN e.line = 1 AND label = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS headed
  FROM edits e LEFT JOIN faulty f
    ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.p - e.inserted AND e.label <> 'I'
  WHERE e.label <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (line - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(a.cost, 0)::BIGINT AS cost,
       coalesce(a.audit, '') AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
