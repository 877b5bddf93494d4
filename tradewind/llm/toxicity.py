"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

Examples are a bounded sample of the labelled rows. Their inverted index is cut into
blocks of examples, and for each term and block holds the greatest weight. A document
visits blocks in the order of their upper bounds and stops when no block left can reach
its k-th similarity: the neighbours are exact. Their distance-weighted votes, calibrated
on the examples themselves with each left out in turn, are the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import passes, text_bytes, words

#: At most so many labelled rows of either label are examples, those with least hash.
EXAMPLES = 1500
#: Neighbours that vote, and examples in a block of the index.
NEIGHBOURS, IN_BLOCK = 15, 64
#: All words of the examples are terms. Those at least so many standard errors from chance
#: under the label, in at least so many examples, weigh so many times their idf.
CHANCE, LEAST_DF = 4.0, 5
#: Terms in at least one of so many examples are multiplied as a matrix, not by postings.
COMMON = 32
#: Documents in one product with that matrix.
TOGETHER = 128
#: Bins of the calibration, and the score from which a document is predicted toxic.
BINS, THRESHOLD = 8, 0.3


def _rows(terms: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term number and count of the words that are terms (sorted hashes)."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = terms[at] == hashes
    pairs, counts = np.unique(docs[hit] * len(terms) + at[hit], return_counts=True)
    return pairs // len(terms), pairs % len(terms), counts


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each word, without the punctuation that ends or begins it."""
    data, offsets = text_bytes(column)
    plain = data.copy()
    plain[_MARKS[plain]] = 32
    _, _, docs, hashes = words(plain, offsets)
    return docs, hashes


_MARKS = np.zeros(256, bool)
_MARKS[[k for k in range(33, 127) if not chr(k).isalnum()]] = True


@dataclass
class Index:
    """Examples as unit TF-IDF vectors, by term and block."""

    terms: np.ndarray  # sorted term hashes
    idf: np.ndarray  # over all documents, times the weight that the label lends a term
    starts: np.ndarray  # postings of term t in block b begin at starts[t * blocks + b]
    examples: np.ndarray
    weights: np.ndarray
    greatest: np.ndarray  # (terms, blocks)
    row: np.ndarray  # of a term in dense, -1 for other than common terms
    dense: np.ndarray  # (common terms, places in blocks): the weights of common terms once more
    ids: np.ndarray
    labels: np.ndarray
    edges: np.ndarray  # calibration: votes from edges[k] score levels[k]
    levels: np.ndarray
    base: float

    @property
    def blocks(self) -> int:
        return self.greatest.shape[1]

    def __getstate__(self) -> dict:
        """The postings alone: what is made of them is many times their size."""
        made = ("starts", "greatest", "row", "dense")
        return {k: v for k, v in vars(self).items() if k not in made} | {"examples": self.examples.astype(np.int32), "df": np.diff(self.starts[:: self.blocks])}

    def __setstate__(self, state: dict) -> None:
        df = state.pop("df")
        vars(self).update(state, examples=state["examples"].astype(np.int64))
        self.starts, self.greatest, self.row, self.dense = _tables(np.repeat(np.arange(len(df)), df), self.examples, self.weights, len(df), len(self.labels))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(counts)) * self.idf[terms]
        return weight / np.sqrt((weight * weight).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (all that have a common term, if fewer) and their
        cosines; equal cosines by example number. shared: what common terms add to each
        example's cosine; a block's bound is the greatest of it and of the other terms."""
        row = self.row[terms]
        if shared is None:
            shared = weights[row >= 0] @ self.dense[row[row >= 0]]
        terms, weights = terms[row < 0], weights[row < 0]
        bounds = shared.reshape(-1, IN_BLOCK).max(1) + weights @ self.greatest[terms].astype(np.float64)
        order = np.argsort(-bounds, kind="stable")
        best, sims = np.zeros(0, np.int64), np.zeros(0)
        at, wide = 0, 8
        while at < len(order) and bounds[order[at]] > 0:
            if len(sims) >= k and bounds[order[at]] < sims[k - 1] - 1e-12:
                break
            some = order[at : at + wide]
            cells = (terms[:, None] * self.blocks + some[None, :]).ravel()
            low = self.starts[cells]
            count = self.starts[cells + 1] - low
            ends = np.cumsum(count)
            rows = np.repeat(low - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
            sums = shared + np.bincount(self.examples[rows], np.repeat(np.repeat(weights, len(some)), count) * self.weights[rows], len(shared))
            found = (some[:, None] * IN_BLOCK + np.arange(IN_BLOCK)).ravel()
            found = found[(sums[found] > 0) & (found != without)]
            best, sims = np.append(best, found), np.append(sims, sums[found])
            if len(sims) > k:
                keep = sims >= np.partition(sims, -k)[-k]
                best, sims = best[keep], sims[keep]
            keep = np.lexsort((best, -sims))[:k]
            best, sims = best[keep], sims[keep]
            at, wide = at + wide, 2 * wide
        return best, sims

    def votes(self, best: np.ndarray, sims: np.ndarray) -> float:
        """The share of toxic neighbours, near ones counting more; the base rate counts as
        one distant neighbour, and alone if there is no other."""
        near = sims**2
        return float((near @ self.labels[best] + 0.1 * self.base) / (near.sum() + 0.1))

    def score(self, vote: np.ndarray) -> np.ndarray:
        return np.interp(vote, self.edges, self.levels)


def fit(documents: DataFrame, labels: DataFrame, held_out, examples: int = EXAMPLES) -> Index | None:
    """The index of a sample of the rows with a label for which held_out is false.

    The sample is at most 2 * `examples` rows, whatever the input; each label's rows with
    least hash of the id, so the same rows in any order. None without both labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return None
    chosen = [known.where(F.col("toxic") == k).orderBy(order).limit(examples) for k in (0, 1)]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = chosen[0].union(chosen[1]).hint("broadcast")  # at most 2 * examples rows of 12 bytes
    rows = texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    parts = _sample_words(rows)
    terms = np.unique(parts[1])
    return _index(rows, parts, *document_frequencies(texts, terms), shares[1] / sum(shares.values()))


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all texts each term (sorted hashes) is, and the number of texts."""
    broadcast = texts.sparkSession.sparkContext.broadcast(terms)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = broadcast.value
        total = np.zeros(len(terms) + 1, np.int64)  # the last counts the texts
        for batch in passes(batches):
            docs, hashes = _words(batch.column("text"))
            total[:-1] += np.bincount(_rows(terms, hashes, docs)[1], minlength=len(terms))
            total[-1] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    counted = texts.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(terms) + 1, np.int64)
    total[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return total[:-1], int(total[-1])


def _sample_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    for batch in passes(iter(rows.to_batches())):
        own, found = _words(batch.column("text"))
        parts.append((own + at, found))
        at += batch.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts))


def _tables(term: np.ndarray, examples: np.ndarray, weights: np.ndarray, terms: int, n: int) -> tuple[np.ndarray, ...]:
    """starts, greatest, row and dense of an Index of n examples."""
    blocks = -(-n // IN_BLOCK)
    cell = term * blocks + examples // IN_BLOCK
    starts = np.append(0, np.cumsum(np.bincount(cell, minlength=terms * blocks))).astype(np.int32)
    greatest = np.zeros(terms * blocks)
    np.maximum.at(greatest, cell, weights)
    greatest = np.where(greatest > 0, np.nextafter(greatest.astype(np.float32), np.float32(2)), np.float32(0))  # no less than the weights
    common = np.flatnonzero(np.bincount(term, minlength=terms) * COMMON >= n)
    row = np.full(terms, -1)
    row[common] = np.arange(len(common))
    dense = np.zeros((len(common), blocks * IN_BLOCK))
    some = row[term] >= 0
    dense[row[term[some]], examples[some]] = weights[some]
    return starts, greatest.reshape(terms, blocks), row, dense


def _index(rows: pa.Table, parts: tuple[np.ndarray, np.ndarray], everywhere: np.ndarray, texts: int, base: float) -> Index:
    docs, hashes = parts
    y = rows["toxic"].to_numpy().astype(np.float64)
    n = len(y)
    terms = np.unique(hashes)
    if not len(terms):
        terms, everywhere = np.zeros(1, np.uint64), np.ones(1, np.int64)
    owner, term, counts = _rows(terms, hashes, docs)
    df = np.bincount(term, minlength=len(terms))
    toxic = np.bincount(term, y[owner], len(terms))
    share = y.mean()
    chance = np.abs(toxic - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
    idf = np.log(1 + texts / np.maximum(everywhere, 1)) * np.where((df >= LEAST_DF) & (chance >= CHANCE), chance, 1)
    weight = (1 + np.log(counts)) * idf[term]
    weight /= np.sqrt(np.bincount(owner, weight * weight, n))[owner]
    # Like examples into like blocks: by their heaviest term.
    heaviest = np.full(n, len(terms))
    order = np.lexsort((-weight, owner))
    lead = order[np.append(True, owner[order][1:] != owner[order][:-1])] if len(order) else order
    heaviest[owner[lead]] = term[lead]
    rank = np.lexsort((np.arange(n), heaviest))
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    order = np.lexsort((place[owner], term))
    examples, weights = place[owner][order], weight[order]
    starts, greatest, row, dense = _tables(term[order], examples, weights, len(terms), n)
    index = Index(terms, idf, starts, examples, weights, greatest, row, dense, rows["doc_id"].to_numpy()[rank], y[rank], np.array([0.0, 1.0]), np.array([0.0, 1.0]), base)
    # Each example's own vote without itself; bins of like votes, weighted to the base rate.
    votes = np.full(n, index.votes(np.zeros(0, np.int64), np.zeros(0)))
    cuts = np.searchsorted(owner, np.arange(n + 1))
    for d in range(n):
        a, b = cuts[d], cuts[d + 1]
        if b > a:
            votes[d] = index.votes(*index.nearest(term[a:b], weight[a:b], without=int(place[d])))
    worth = np.where(y == 1, base / share, (1 - base) / (1 - share))
    order = np.argsort(votes, kind="stable")
    inside = [part for part in np.array_split(order, BINS) if len(part)]
    centre = np.array([votes[p].mean() for p in inside])
    level = np.array([(worth[p] @ y[p] + base) / (worth[p].sum() + 1) for p in inside])
    level = np.maximum.accumulate(level)
    keep = np.append(True, np.diff(centre) > 1e-9)
    index.edges, index.levels = centre[keep], level[keep]
    return index


def score(documents: DataFrame, index: Index | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, evidence (ids, labels and cosines of the nearest examples) per row.

    Only the text counts, but an example never votes for the row with its own id: its label
    would be an input of that row's score. Null and empty texts, and texts without a term of the index, have
    no evidence: their vote is the base rate, calibrated like any vote. Without an index
    all scores are 0.
    """
    broadcast = documents.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        place = {own: k for k, own in enumerate(index.ids.tolist())} if index else {}
        for batch in passes(batches):
            n = batch.num_rows
            own = [place.get(i, -1) for i in batch.column("doc_id").to_pylist()]
            vote, found = np.full(n, index.base if index else 0.0), [([], [], [])] * n
            if index:
                docs, hashes = _words(batch.column("text"))
                owner, term, counts = _rows(index.terms, hashes, docs)
                weight = (1 + np.log(counts)) * index.idf[term]
                weight /= np.sqrt(np.bincount(owner, weight * weight, n))[owner]
                cuts = np.searchsorted(owner, np.arange(n + 1))
                for first in range(0, n, TOGETHER):
                    part = slice(cuts[first], cuts[min(first + TOGETHER, n)])
                    row = index.row[term[part]]
                    query = np.zeros((min(TOGETHER, n - first), len(index.dense)))
                    query[owner[part][row >= 0] - first, row[row >= 0]] = weight[part][row >= 0]
                    shared = query @ index.dense
                    for d in (np.flatnonzero(np.diff(cuts[first : first + len(query) + 1])) + first).tolist():
                        a, b = cuts[d], cuts[d + 1]
                        best, sims = index.nearest(term[a:b], weight[a:b], without=own[d], shared=shared[d - first])
                        vote[d] = index.votes(best, sims)
                        found[d] = (index.ids[best], index.labels[best].astype(np.int32), sims)
                vote = index.score(vote)
            lists = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(vote), *lists], ["doc_id", "score", "near_ids", "near_labels", "near_cosines"])

    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double, near_ids array<long>, near_labels array<int>, near_cosines array<double>")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence, for each row of documents.

    Rows whose crc32 of the id as text leaves 2 modulo 4 are held out: their labels are
    never read into the index. A null id is not held out.
    """
    scored = score(documents, fit(documents, labels, held_out))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "near_ids", "near_labels", "near_cosines")
