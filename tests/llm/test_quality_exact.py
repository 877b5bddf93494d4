"""The quality operator against a plain loop over documents."""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from texts import prose

from tradewind.llm import quality

SIZE = 1 << quality.BITS


def _expected(rows, labels, uniform):
    """Kept or not for each row: both models, the cut, the draw, by counting and sorting."""
    grams = [quality._features(pa.array([t], pa.string()))[1].tolist() for _, t in rows]
    raw = Counter(g for own in grams for g in own)
    good = Counter(g for (d, _), own in zip(rows, grams) for g in own if labels.get(d) == 1)
    every, chosen = sum(raw.values()), sum(good.values())
    ratio = lambda g: math.log((good[g] + 1) / (chosen + SIZE)) - math.log((raw[g] + 1) / (every + SIZE))
    value = [sum(map(ratio, own)) / len(own) if own else math.nan for own in grams]
    known = sorted((v, labels[d]) for (d, _), v in zip(rows, value) if d in labels and not math.isnan(v))
    sizes = Counter(y for _, y in known)
    apart = [sum(1 / sizes[0] if y == 0 else -1 / sizes[1] for _, y in known[:n]) for n in range(len(known) + 1)]
    at = next(n for n, a in enumerate(apart) if a > max(apart) - 1e-12)
    cut = (known[at - 1][0] + known[min(at, len(known) - 1)][0]) / 2 if at else known[0][0]
    drawn = [v / quality.TEMPERATURE - math.log(-math.log(uniform[d])) for (d, _), v in zip(rows, value)]
    k = sum(v >= cut for v in value)
    least = sorted((x for x in drawn if not math.isnan(x)), reverse=True)[k - 1]
    return value, [x >= least for x in drawn]


def test_equals_a_plain_loop(spark):
    bad = "click here buy now cheap offer win free"
    rows = [(n, prose(n, 60) if n % 3 else f"{bad} {prose(n, 12)} {bad}") for n in range(120)]
    rows += [(4, prose(4, 60)), (500, ""), (501, None), (502, "  \n"), (503, prose(503, 3000))]  # a repeated row, no words, a long text
    labels = {n: int(n % 3 > 0) for n in range(0, 120, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drawn", F.lit("own")).withColumn("importance", F.lit(1))
    marks = spark.createDataFrame([*labels.items(), (None, 1), (7, None)], "doc_id long, quality int")
    unit = (F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    uniform = dict(docs.select("doc_id", unit).collect())
    value, kept = _expected(rows, labels, uniform)
    got = {}
    for r in quality.quality(docs, marks).collect():
        got.setdefault(r["doc_id"], []).append((r["importance"], r["kept"]))
    for (d, _), v, keep in zip(rows, value, kept):
        for found, stays in got[d]:
            assert stays == keep and (math.isnan(found) and math.isnan(v) or abs(found - v) < 1e-9), d
    assert sum(map(len, got.values())) == len(rows)
    stay = quality.keep_good(docs, marks)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(d for (d, _), keep in zip(rows, kept) if keep)
    assert {r["drawn"] for r in stay.collect()} == {"own"}
