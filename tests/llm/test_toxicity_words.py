import numpy as np
from texts import prose

from tradewind.llm import toxicity


def test_every_word_of_the_examples_counts(spark):
    """Without any toxic word a copy still finds its example, and df is the corpus's."""
    texts = [(k, f"onlyin{k} {prose(k, 40)}" + (" you idiot, pathetic clown" if k % 4 == 0 else "")) for k in range(200)]
    more = [(1000 + k, f"onlyin{k} filler") for k in range(1, 200, 4)]
    docs = spark.createDataFrame(texts + more, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in texts], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, lambda c: c < 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    assert all(r["near_ids"] for r in got.values())
    assert all(got[1000 + k]["near_ids"][0] == k for k in range(1, 200, 4))
    words, counts = toxicity._words(__import__("pyarrow").array([t for _, t in texts + more]))[::-1], {}
    for h, d in set(zip(words[0].tolist(), words[1].tolist())):
        counts[h] = counts.get(h, 0) + 1
    terms = index.terms.tolist()
    frequencies, total = toxicity.document_frequencies(docs, index.terms)
    assert total == len(texts) + len(more) and frequencies.tolist() == [counts[h] for h in terms]


def test_sample_without_words(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 20 and all(0 <= r["score"] <= 1 and r["near_ids"] == [] for r in found)
    assert toxicity.toxicity(docs.where("false"), labels).collect() == []


def test_scores_equal_a_plain_search_without_the_own_label(spark):
    """Vectors, neighbours and votes of every row by plain dictionaries; turning over a row's own label changes no score of it."""
    import math

    texts = [(k, f"{prose(k % 17, 25)} {prose(k, 6)}" + (" you idiot, pathetic clown" if k % 4 == 0 else "")) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in texts], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, lambda c: c < 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    idf, arrow = dict(zip(index.terms.tolist(), index.idf.tolist())), __import__("pyarrow")
    vectors = {}
    for k, text in texts:
        counts = {}
        for h in toxicity._words(arrow.array([text]))[1].tolist():
            counts[h] = counts.get(h, 0) + 1
        raw = {h: (1 + math.log(c)) * idf[h] for h, c in counts.items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        vectors[k] = {h: w / size for h, w in raw.items()}
    label = {k: float(k % 4 == 0) for k, _ in texts}
    for k, vector in vectors.items():
        sims = {j: sum(w * other.get(h, 0.0) for h, w in vector.items()) for j, other in vectors.items() if j != k}
        near = sorted((s for s in sims.values() if s > 0), reverse=True)[: toxicity.NEIGHBOURS]
        assert k not in got[k]["near_ids"] and np.allclose(got[k]["near_cosines"], near, atol=1e-9)
        assert all(abs(sims[j] - s) < 1e-9 for j, s in zip(got[k]["near_ids"], got[k]["near_cosines"]))
        votes = [(s * s, label[j]) for j, s in zip(got[k]["near_ids"], near)]
        vote = (sum(w * y for w, y in votes) + 0.1 * index.base) / (sum(w for w, _ in votes) + 0.1)
        assert abs(got[k]["score"] - float(np.interp(vote, index.edges, index.levels))) < 1e-9
