"""A search index that lasts: postings bucketed by token, and the vocabulary beside them.

A search meets its few words with the vocabulary, then reads only the buckets of the tokens
that match: no scan of the catalogue and no rebuilding of postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import words
from tradewind.sources.shared import new_table

#: Weights of strong and weak fields, and of exact, prefix and fuzzy matches.
STRONG, WEAK, EXACT, PREFIX, FUZZY = 2, 1, 1.0, 0.6, 0.45
#: Matching tokens up to which a search names them, so that only their buckets are read;
#: beyond, it joins the postings by their buckets.
NAMED = 500


def postings(docs: DataFrame, strong: list[str], weak: list[str], key: str = "ord") -> DataFrame:
    """(key, token, weight): each token of a row once, strong before weak. One pass: both
    texts are read in the row, and no rows meet."""
    found = {name: F.array_distinct(words.tokens(F.concat_ws(" ", *cols))) for name, cols in (("_strong", strong), ("_weak", weak))}
    read = docs.select(key, *(c.alias(n) for n, c in found.items()))

    def weighed(tokens: Column, weight: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(weight).alias("weight")))

    every = F.concat(weighed(F.col("_strong"), STRONG), weighed(F.array_except("_weak", "_strong"), WEAK))
    return read.select(key, F.explode(every).alias("p")).select(key, "p.token", "p.weight")


def match(q: Column, token: Column) -> Column:
    """How well a token answers a word: equal, begins with it, or within a few edits; else null."""
    budget = F.when(~q.rlike("^[a-z]+\\z"), 0).when(F.length(q) >= 8, 2).when(F.length(q) >= 4, 1).otherwise(0)
    near = (budget > 0) & token.rlike("^[a-z]+\\z") & (F.abs(F.length(q) - F.length(token)) <= budget) & (F.levenshtein(q, token) <= budget)
    return F.when(q == token, EXACT).when((F.length(q) >= 2) & F.startswith(token, q), PREFIX).when(near, FUZZY)


class SearchIndex:
    """Tables of one catalogue: `<name>_postings` (token, key, weight), bucketed and sorted
    by token, and `<name>_words` (token, docs, weight)."""

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.name, self.key = spark, name, key

    @classmethod
    def build(cls, docs: DataFrame, strong: list[str], weak: list[str], key: str = "ord", buckets: int | None = None) -> SearchIndex:
        """Write the index of docs. Rows without words are in no posting, but `keys` has
        them; a null key is a row like any other. An empty catalogue gives empty tables."""
        spark = docs.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name, place = new_table(spark, "search")
        rows = postings(docs, strong, weak, key)
        # Each bucket is written by one task: no file for each pair of task and bucket.
        rows.repartition(n, "token").sortWithinPartitions("token").write.bucketBy(n, "token").sortBy("token").option("path", f"{place}/postings").saveAsTable(f"{name}_postings")
        # Bucketed reading makes this aggregation local to its bucket.
        counted = spark.table(f"{name}_postings").groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum("weight").alias("weight"))
        counted.write.option("path", f"{place}/words").saveAsTable(f"{name}_words")
        docs.select(key).write.option("path", f"{place}/keys").saveAsTable(f"{name}_keys")
        return cls(spark, name, key)

    def postings(self) -> DataFrame:
        return self.spark.table(f"{self.name}_postings")

    def words(self) -> DataFrame:
        return self.spark.table(f"{self.name}_words")

    def asked(self, text: str) -> list[str]:
        """The words of a query, each once; read without a table."""
        return self.spark.sql("SELECT :text AS text", args={"text": text}).select(F.array_distinct(words.tokens(F.col("text")))).first()[0]

    def search(self, text: str) -> DataFrame:
        """(key, score, matched): rows that match every word, or all but one if none does;
        every row, with score 0, if the query has no word."""
        asked = self.asked(text)
        key = self.key
        if not asked:
            return self.spark.table(f"{self.name}_keys").select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"))
        # One column for each word, so that no words are joined: a query has a handful.
        bases = [match(F.lit(w), F.col("token")) for w in asked]
        matching = self.words().select("token", *(b.alias(f"b{k}") for k, b in enumerate(bases))).where(F.coalesce(*(F.col(f"b{k}") for k in range(len(asked)))).isNotNull())
        named = matching.limit(NAMED + 1).select("token").collect()
        rows = self.postings()
        if len(named) <= NAMED:
            rows = rows.where(F.col("token").isin([r[0] for r in named]) if named else F.lit(False))
            rows = rows.select(key, "weight", *(b.alias(f"b{k}") for k, b in enumerate(bases)))
        else:
            rows = rows.join(matching, "token").select(key, "weight", *(f"b{k}" for k in range(len(asked))))
        best = rows.groupBy(key).agg(*(F.max(F.col(f"b{k}").cast("decimal(4,2)") * F.col("weight")).alias(f"s{k}") for k in range(len(asked))))
        scores = [F.col(f"s{k}") for k in range(len(asked))]
        total = sum((F.coalesce(s, F.lit(0)) for s in scores[1:]), F.coalesce(scores[0], F.lit(0)))
        found = best.select(key, total.cast("double").alias("score"), sum((s.isNotNull().cast("long") for s in scores[1:]), scores[0].isNotNull().cast("long")).alias("matched"))
        need = found.agg(F.when(F.max("matched") >= len(asked), len(asked)).otherwise(max(len(asked) - 1, 1)).alias("need"))
        return found.join(F.broadcast(need), F.col("matched") >= F.col("need")).select(key, "score", "matched")


_OPEN: dict[tuple, SearchIndex] = {}


def index_of(docs: DataFrame, strong: list[str], weak: list[str], key: str = "ord", fresh: bool = False) -> SearchIndex:
    """The session's index of docs, built once for the files that docs reads. Files are
    never changed in place by Spark, so new contents are new files and a new index."""
    spark = docs.sparkSession
    which = (spark.sparkContext.applicationId, tuple(sorted(docs.inputFiles())), tuple(strong), tuple(weak), key, docs.semanticHash())
    if fresh or which not in _OPEN:
        _OPEN[which] = SearchIndex.build(docs, strong, weak, key)
    return _OPEN[which]
