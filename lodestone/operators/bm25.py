"""BM25 over normalised tables: postings, document statistics, corpus statistics.

Scoring touches only the postings of the query's terms; the query side, if its
terms are few enough, and the one-row statistics are broadcast, and the sums per
document are combined before they are shuffled. Over texts that were not indexed, a
search tokenizes once and shuffles a row per text and one per term that the queries
have too. What is shuffled goes by entry, in partitions of about PART_ROWS texts, so
that the rest of the work on an entry is done where it is and a task's memory does not
grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.2
    b: float = 0.75


#: Distinct terms of all queries, and terms of each query, that are broadcast.
BROADCAST_TERMS = 1_000_000
#: Texts whose terms are counted, and scored, together.
PART_ROWS = 2048


def _small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if counted to be small enough, else joined by shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else rows


def _spread(docs: DataFrame) -> DataFrame:
    """Few files make few tasks; tokenizing is worth more of them."""
    many = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(many) if len(docs.inputFiles()) < many else docs


def _parts(docs: DataFrame) -> int:
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // PART_ROWS))


def tokens(docs: DataFrame) -> DataFrame:
    """entry_id, tokens of docs(entry_id, text)."""
    return docs.select("entry_id", tokenize(F.col("text")).alias("tokens"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """entry_id, term, tf. Texts are shuffled, as they are smaller than their postings;
    the explosion is aggregated where they are then."""
    each = tokens(docs.repartition(_parts(docs), "entry_id")).select("entry_id", F.explode("tokens").alias("term"))
    return each.groupBy("entry_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return tokens(docs).select("entry_id", F.size("tokens").cast("long").alias("len"))


def lengths_of(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """entry_id, len of docs(entry_id), by postings that are stored."""
    sums = postings.groupBy("entry_id").agg(F.sum("tf").alias("len"))
    return docs.select("entry_id").join(sums, "entry_id", "left").select("entry_id", F.coalesce("len", F.lit(0).cast("long")).alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("len"), F.lit(0)).cast("long")
    n = F.count(F.lit(1))
    return lengths.agg(n.alias("n"), total.alias("total_tokens"), F.when(n == 0, F.lit(0.0)).otherwise(total / n).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def document_frequency(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf over the whole corpus, whatever is filtered later."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def _like(rows: DataFrame, other: DataFrame) -> DataFrame:
    """A row per row of ``other`` at most, so broadcast where that is."""
    return F.broadcast(rows) if other.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else rows


@dataclass
class Bm25Index:
    postings: DataFrame  # term, entry_id, tf
    lengths: DataFrame  # entry_id, len
    params: Bm25Params = Bm25Params()
    docs: DataFrame | None = None  # the texts, where the tables are not stored

    @staticmethod
    def build(docs: DataFrame, params: Bm25Params = Bm25Params()) -> Bm25Index:
        return Bm25Index(term_frequencies(docs).select("term", "entry_id", "tf"), doc_lengths(_spread(docs)), params, docs)

    def add(self, docs: DataFrame) -> Bm25Index:
        more = Bm25Index.build(docs, self.params)
        both = self.docs.select("entry_id", "text").unionByName(docs.select("entry_id", "text")) if self.docs is not None else None
        return Bm25Index(self.postings.unionByName(more.postings), self.lengths.unionByName(more.lengths), self.params, both)

    @property
    def stats(self) -> DataFrame:
        return corpus_stats(self.lengths)

    def vocabulary_size(self) -> DataFrame:
        return self.postings.agg(F.count_distinct("term").alias("vocabulary_size"))

    def scores(self, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, entry_id, score of queries(query_id, text) for entries that
        share a term. ``allowed`` (entry_id) admits entries; it changes no
        statistics. Each distinct term of a query counts once."""
        terms = _small(queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")))
        distinct = _small(terms.select("term").distinct())
        if self.docs is None:
            wanted, stats = self.postings.join(distinct, "term").join(self.lengths, "entry_id"), self.stats
        else:
            wanted, stats = self._met(distinct)
        df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
        admitted = wanted.withColumn("admitted", F.lit(True))
        if allowed is not None and self.docs is None:
            admitted = admitted.join(allowed.select("entry_id"), "entry_id", "left_semi")
        elif allowed is not None:  # what is not admitted goes last: a filter here would go below the exchange
            admitted = wanted.join(allowed.select("entry_id", F.lit(True).alias("admitted")).distinct(), "entry_id", "left")
        k1, b = self.params.k1, self.params.b
        tf = F.col("tf").cast("double")
        size = F.when(F.col("avgdl") > 0, F.col("len") / F.col("avgdl")).otherwise(F.lit(0.0))
        part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size))
        scored = admitted.join(_like(weight, distinct), "term").select("term", "entry_id", "admitted", part.alias("part"))
        sums = scored.join(terms, "term").groupBy("query_id", "entry_id").agg(F.sum("part").alias("score"), F.max("admitted").alias("admitted"))
        return sums.where("admitted").drop("admitted")

    def _met(self, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
        """term, entry_id, tf, len of the terms given, and the statistics, from one
        pass over the texts: what no query asks for is one row per text. Both come
        from the same exchange, as neither filter can go below the aggregation."""
        made = tokens(_spread(self.docs)).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
        each = made.select("entry_id", F.size("tokens").cast("long").alias("len"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
        asked = each.join(distinct.select("term", F.lit(1).alias("hit")), "term", "left").where("hit = 1 or term = ''")
        # Neither column can be null: else filters that joins bring along would go below the exchange.
        kept = asked.select("entry_id", "len", F.coalesce("term", F.lit("")).alias("term"), F.coalesce("hit", F.lit(0)).alias("hit"))
        met = kept.repartition(_parts(self.docs), "entry_id").groupBy("entry_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("hit").alias("hit"))
        n, total = F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum(F.col("len") * F.col("tf")), F.lit(0))
        stats = met.where("hit = 0").agg(n.alias("n"), total.alias("total_tokens"), F.when(n == 0, F.lit(0.0)).otherwise(total / n).alias("avgdl"))
        return met.where("hit = 1").select("term", "entry_id", "tf", "len"), stats

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, entry_id, score, rank: the k best, ties to the lower id."""
        if k <= 0:
            queries = queries.limit(0)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "entry_id")
        return self.scores(queries, allowed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, text string")
