"""Benchmark decontamination with a positional inverted index, in DataFrame
operations only.

The index holds term, document and position of every word of the training texts
that a benchmark has too, sorted by term, so that the list of a rare term is read
without the others. A phrase is looked up from its rarest term: positions less
the term's place in the phrase are possible starts, these are intersected with
those of the second rarest term, and what is left is verified term by term.

Words: A-Z folded, runs of ASCII digits, letters and non-ASCII characters. A
window is ten consecutive words of an item, or all of a shorter one.

Broadcasts are of tables whose rows were counted and are at most
``BROADCAST_ROWS``; larger ones are joined by shuffle.

Defined results: null or empty texts have no words; items without words have no
window; equal windows of several items count for each; repeated documents get a
row each; items with equal item_id are one item, and a null item_id is the empty
string; an empty documents table gives no rows, an empty benchmark no hits; other
columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import staged

WINDOW = 10
BROADCAST_ROWS = 1_000_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word holds this character, so its position tells the number of words.
_END = "\u0000"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(folded, F.lit(_WORD), F.lit(0))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


@dataclass
class PhraseIndex:
    """``postings``: term_id, row, pos, and in the rows of term -1 (one for each
    document) doc_id, with pos the number of words. ``windows``: window, term_id,
    place, n. ``owners``: window, item_id."""

    postings: DataFrame
    windows: DataFrame
    owners: DataFrame

    def lists(self, rarest: int) -> tuple[DataFrame, DataFrame]:
        """Of each window all of whose terms occur: its terms by rarity, 1 the
        rarest; and the windows as they are."""
        frequency = self.postings.where("term_id >= 0").groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
        by_rarity = Window.partitionBy("window").orderBy("df", "place")
        known = self.windows.join(frequency, "term_id").withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("window"))).where("known = n")
        ranked = staged(known.withColumn("rarity", F.row_number().over(by_rarity)), "ranked")
        return ranked.where(F.col("rarity") <= rarest), ranked

    def starts(self, terms: DataFrame) -> DataFrame:
        """Offset-adjusted lists: window, row, start for every posting of a term."""
        keyed = small(terms.select("term_id", "window", "place", "n"))
        at = self.postings.select("term_id", "row", "pos").join(keyed, "term_id")
        return at.select("window", "row", (F.col("pos") - F.col("place")).alias("start"), "n").where("start >= 0")

    def phrases(self) -> DataFrame:
        """window, row, start, n of every exact occurrence of a window."""
        rare, ranked = self.lists(2)
        first = self.starts(rare.where("rarity = 1"))
        second = self.starts(rare.where("rarity = 2")).drop("n")
        both = first.where("n > 1").join(second, ["window", "row", "start"], "left_semi").unionByName(first.where("n = 1"))
        candidates = staged(both, "phrase-candidates")
        done = candidates.where("n <= 2")
        open_ = candidates.where("n > 2")
        rows = staged(open_.select("row").distinct(), "candidate-rows")
        near = self.postings.where("term_id >= 0").join(small(rows), "row", "left_semi").select("row", "pos", "term_id")
        wanted = open_.join(small(ranked.where("rarity > 2").select("window", "term_id", "place")), "window")
        wanted = wanted.select("window", "row", "start", "n", "term_id", (F.col("start") + F.col("place")).alias("pos"))
        found = wanted.join(near, ["row", "pos", "term_id"]).groupBy("window", "row", "start", "n").agg(F.count(F.lit(1)).alias("terms"))
        return found.where("terms = n - 2").drop("terms").unionByName(done)

    def proximity(self, slop: int) -> DataFrame:
        """window, row, pos: places of a window's rarest term with all other
        terms of the window (each as often as it has it) no further than
        ``slop`` words away, in any order."""
        rare, ranked = self.lists(1)
        keyed = small(rare.select("term_id", "window", "n"))
        seeds = staged(self.postings.join(keyed, "term_id").select("window", "row", F.col("pos").alias("at"), "n"), "near-candidates")
        rows = staged(seeds.select("row").distinct(), "near-rows")
        needed = ranked.groupBy("window", "term_id").agg(F.count(F.lit(1)).alias("times"))
        distinct = needed.groupBy("window").agg(F.count(F.lit(1)).alias("kinds"))
        near = self.postings.where("term_id >= 0").join(small(rows), "row", "left_semi")
        wanted = seeds.join(needed, "window")
        close = wanted.join(near.select("row", "term_id", "pos"), ["row", "term_id"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
        per_term = close.groupBy("window", "row", "at", "term_id", "times").agg(F.count(F.lit(1)).alias("got")).where("got >= times")
        whole = per_term.groupBy("window", "row", "at").agg(F.count(F.lit(1)).alias("have")).join(distinct, "window").where("have = kinds")
        return whole.select("window", "row", F.col("at").alias("pos"))


def build(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> PhraseIndex:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
    begin = F.when(F.size("words") > size, F.sequence(F.lit(0), F.size("words") - size)).otherwise(F.array(F.lit(0)))
    cut = items.where(F.size("words") > 0).withColumn("begin", F.explode(begin)).select("item_id", F.slice("words", F.col("begin") + 1, size).alias("words"))
    cut = staged(cut.distinct(), "benchmark-windows")
    distinct = staged(cut.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    terms = distinct.select("window", F.posexplode("words").alias("place", "term"), F.size("words").alias("n"))
    end = documents.sparkSession.createDataFrame([(_END, -1)], "term string, term_id long")
    vocabulary = staged(terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()).unionByName(end), "vocabulary")
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    each = docs.select("row", "doc_id", F.posexplode(F.array_append("words", F.lit(_END))).alias("pos", "term"))
    found = each.join(small(vocabulary), "term").select("term_id", "row", "pos", F.when(F.col("term_id") < 0, F.col("doc_id")).alias("doc_id"))
    postings = staged(found.sortWithinPartitions("term_id", "row", "pos"), "postings")
    windows = staged(terms.join(small(vocabulary), "term").select("window", "term_id", "place", "n"), "window-terms")
    owners = staged(cut.join(distinct, "words").select("window", "item_id"), "owners")
    return PhraseIndex(postings, windows, owners)


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and row, the
    document's number in this scan."""
    index = build(documents, benchmark, size)
    found = staged(index.phrases(), "phrases")
    hit = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    hits = hit.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    owned = found.select("row", "window").distinct().join(small(index.owners), "window").select("row", "item_id").distinct()
    items = owned.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    all_rows = index.postings.where("term_id < 0").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = all_rows.join(hits, "row", "left").join(items, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "row",
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, all columns, in which no window occurs."""
    numbered = staged(documents.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = contamination(numbered.withColumn("doc_id", F.col("__row")), benchmark, size)
    bad = found.where("contaminated").select(F.col("doc_id").alias("__row"))
    return numbered.join(bad, "__row", "left_anti").drop("__row")
