"""Queries of the retrieval engine over the driver's tables, each with the DuckDB
SQL that gives the same rows.

Commits are ``documents`` joined with ``events`` on their ids; vectors are
``embeddings``; the hybrid corpus is what both have.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.embed import HashedEmbedder
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import bm25, fusion, hnsw, knn, merge, mmr
from lodestone.operators.filters import SearchFilters, candidate_count
from lodestone.output import json_document, text_lines
from lodestone.plans import planner
from lodestone.plans.engine import Engine, SearchRequest, diversify, hybrid_ranking
from lodestone.plans.planner import Mode, depth
from lodestone.sources import git

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K = 10


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the data --------------------------------------------------------------


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, hash, author, date, message, diff_summary; French documents
    stand for commits from before the ``Files:`` line was written."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    files = F.concat(F.lit("Files: src/"), F.col("lang"), F.lit(".rs, docs/"), F.col("source"), F.lit(".md\n+"), F.col("source"))
    diff = F.when(F.col("lang") == "fr", F.concat(F.lit("+modified src/"), F.col("lang"), F.lit(".rs"))).otherwise(files)
    return d.join(e.select("event_id", "ts"), d.doc_id == e.event_id).select(
        F.col("doc_id").alias("entry_id"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("source").alias("author"), F.col("ts").alias("date"), F.col("text").alias("message"), diff.alias("diff_summary")
    )


COMMITS = """commits AS (
  SELECT doc_id AS entry_id, md5(text) AS hash, source AS author, ts AS date, text AS message,
    CASE WHEN lang = 'fr' THEN '+modified src/' || lang || '.rs'
      ELSE 'Files: src/' || lang || '.rs, docs/' || source || '.md' || chr(10) || '+' || source END AS diff_summary
  FROM documents JOIN events ON event_id = doc_id)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, text, source, embedding."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id).select(F.col("doc_id").alias("entry_id"), "text", "source", "embedding", "label")


DOCS = "docs AS (SELECT doc_id AS entry_id, text FROM documents)"
HYBRID = "docs AS (SELECT doc_id AS entry_id, text, source, embedding, label FROM documents JOIN embeddings ON vec_id = doc_id)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding", "label")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query of single-query searches: the vector with id 0."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first().embedding


def first_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item with the lowest id, as query 0."""
    best = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    return best.select(F.lit(0).cast("long").alias("query_id"), "text")


# Tokens of t in DuckDB, whose patterns cannot look around: a mark is put at the
# boundaries, kind by kind.
_MARKED = "w"
for _a, _b in ((r"(\P{Lu})(\p{Lu})", r"\1" + "\x1f" + r"\2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1" + "\x1f" + r"\2"), (r"(\p{L})(\p{N})", r"\1" + "\x1f" + r"\2"), (r"(\p{N})(\p{L})", r"\1" + "\x1f" + r"\2")):
    _MARKED = f"regexp_replace({_MARKED}, '{_a}', '{_b}', 'g')"


def _tokens(t: str) -> str:
    return rf"""flatten(list_transform(
    list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+'), lambda w: strlen(w) BETWEEN 2 AND 40),
    lambda w: list_concat([lower(w)], list_filter(list_transform(string_split({_MARKED}, chr(31)), lambda p: lower(p)),
      lambda p: strlen(p) >= 2 AND p <> lower(w)))))"""


TF = f"""tf AS (
  SELECT entry_id, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT entry_id, unnest({_tokens("text")}) AS term FROM docs) GROUP BY ALL),
len AS (SELECT entry_id, CAST(len({_tokens("text")}) AS BIGINT) AS len FROM docs),
stats AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(len), 0) AS BIGINT) AS total_tokens, coalesce(sum(len) / count(*), 0.0) AS avgdl FROM len),
df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term)"""


def _bm25(queries: str, admit: str = "true") -> str:
    """CTEs up to bm(query_id, entry_id, score, rank)."""
    return f"""{TF},
terms AS (SELECT DISTINCT query_id, unnest({_tokens("text")}) AS term FROM ({queries})),
bm AS (
  SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) AS rank FROM (
    SELECT query_id, tf.entry_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
    FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.entry_id = tf.entry_id JOIN docs d ON d.entry_id = tf.entry_id CROSS JOIN stats
    WHERE {admit} GROUP BY query_id, tf.entry_id))"""


ITEM = "SELECT 0::BIGINT AS query_id, text FROM benchmark ORDER BY item_id LIMIT 1"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


Q = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"


def _knn(source: str, where: str = "true") -> str:
    """CTE near(entry_id, dist, rank), all rows ranked."""
    return f"""{Q}, near AS (
  SELECT entry_id, dist, row_number() OVER (ORDER BY dist, entry_id) AS rank
  FROM (SELECT entry_id, round(1 - {_dot("embedding", "qv")}, 6) + 0.0 AS dist FROM {source}, q WHERE {where}))"""


VECS = "vecs AS (SELECT vec_id AS entry_id, embedding, label FROM embeddings)"

# --- projections and text ---------------------------------------------------


@query(f"WITH {COMMITS} SELECT entry_id, message || chr(10) || author || chr(10) || diff_summary AS doc_text FROM commits")
def doc_text(spark, d):
    return commits(spark, d).select("entry_id", T.doc_text(F.col("message"), F.col("author"), F.col("diff_summary")).alias("doc_text"))


_FILES = """CASE WHEN starts_with(diff_summary, 'Files: ') THEN list_filter(list_transform(string_split(substr(split_part(diff_summary, chr(10), 1), 8), ', '), lambda p: trim(p)), lambda p: p <> '' AND p <> '...') END"""


@query(f"WITH {COMMITS} SELECT entry_id, array_to_string({_FILES}, '|') AS files, {_FILES} IS NULL AS legacy FROM commits")
def changed_files(spark, d):
    files = T.changed_files(F.col("diff_summary"))
    return commits(spark, d).select("entry_id", F.array_join(files, "|").alias("files"), files.isNull().alias("legacy"))


@query("""SELECT doc_id AS entry_id, 'Files: ' || array_to_string(list_sort(list_distinct(['src/' || lang || '.rs', 'docs/' || source || '.md', 'src/' || lang || '.rs', 'a/' || source])), ', ') AS line FROM documents""")
def changed_paths(spark, d):
    rows = table(spark, d, "documents")
    code = F.concat(F.lit("src/"), F.col("lang"), F.lit(".rs"))
    old = F.array(code, F.concat(F.lit("docs/"), F.col("source"), F.lit(".md")))
    return rows.select(F.col("doc_id").alias("entry_id"), T.changed_paths(old, F.array(code, F.concat(F.lit("a/"), F.col("source")))).alias("line"))


@query("""SELECT doc_id AS entry_id, CASE WHEN strlen(text) <= 2000 THEN text ELSE
  array_to_string(list_transform(list_filter(range(1, length(text) + 1), lambda i: i <= 2000 AND strlen(left(text, i - 1)) < 2000), lambda i: text[i]), '') || chr(10) || '... (truncated)' END AS cut FROM documents""")
def truncate_text(spark, d):
    return docs(spark, d).select("entry_id", T.truncate_bytes(F.col("text"), 2000).alias("cut"))


@query(rf"""WITH {COMMITS} SELECT entry_id, regexp_replace(split_part(message, chr(10), 1), '\r$', '') AS subject,
  regexp_replace(message, '\s+$', '') AS message, left(hash, 7) AS short_hash,
  strftime(date, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date, array_to_string(string_split(diff_summary, chr(10))[1:2], chr(10) || '   ') AS preview FROM commits""")
def subject_line(spark, d):
    c = F.col
    return commits(spark, d).select("entry_id", T.subject(c("message")).alias("subject"), T.trim_end(c("message")).alias("message"), T.short_hash(c("hash")).alias("short_hash"), T.rfc3339(c("date")).alias("date"), T.diff_preview(c("diff_summary")).alias("preview"))


@query(f"WITH {DOCS} SELECT entry_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM docs")
def tokenize_docs(spark, d):
    return docs(spark, d).select("entry_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


# --- filters ------------------------------------------------------------------

AUTHOR, AFTER, BEFORE, FILE = "SRC1", "2024-01-02", "2024-01-02", "src/de"
_WHERE = {
    "author": "contains(lower(author), 'src1')",
    "after": "date >= TIMESTAMP '2024-01-02 00:00:00'",
    "before": "date <= TIMESTAMP '2024-01-02 23:59:59'",
    "file": f"coalesce(list_bool_or(list_transform({_FILES}, lambda p: contains(p, 'src/de'))), CASE WHEN {_FILES} IS NULL THEN contains(diff_summary, 'src/de') ELSE false END)",
}


def _filtered(spark, d, **kw):
    return SearchFilters(**kw).apply(commits(spark, d)).select("entry_id", "author", "date")


def _filter_sql(*names: str) -> str:
    return f"WITH {COMMITS} SELECT entry_id, author, date FROM commits WHERE {' AND '.join(_WHERE[n] for n in names)}"


@query(_filter_sql("author"))
def filter_author(spark, d):
    return _filtered(spark, d, author=AUTHOR)


@query(_filter_sql("after"))
def filter_after(spark, d):
    return _filtered(spark, d, after=AFTER)


@query(_filter_sql("before"))
def filter_before(spark, d):
    return _filtered(spark, d, before=BEFORE)


@query(_filter_sql("file"))
def filter_file(spark, d):
    return _filtered(spark, d, file=FILE)


@query(_filter_sql("author", "after", "before", "file"))
def filter_combined(spark, d):
    return _filtered(spark, d, author=AUTHOR, after=AFTER, before=BEFORE, file=FILE)


@query(f"WITH {COMMITS} SELECT CAST(count(*) AS BIGINT) AS candidates FROM commits WHERE {_WHERE['author']} AND {_WHERE['after']}")
def candidate_count_filtered(spark, d):
    return candidate_count(commits(spark, d), SearchFilters(author=AUTHOR, after=AFTER))


# --- BM25 -----------------------------------------------------------------------


@query(f"WITH {DOCS}, {TF} SELECT entry_id, term, tf FROM tf")
def term_frequencies(spark, d):
    return bm25.Bm25Index.build(docs(spark, d)).postings.select("entry_id", "term", "tf")


@query(f"WITH {DOCS}, {TF} SELECT entry_id, len FROM len")
def doc_lengths(spark, d):
    return bm25.Bm25Index.build(docs(spark, d)).lengths


@query(f"WITH {DOCS}, {TF} SELECT n, total_tokens, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, d):
    return bm25.Bm25Index.build(docs(spark, d)).stats.withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {DOCS}, {TF} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats")
def doc_frequency(spark, d):
    index = bm25.Bm25Index.build(docs(spark, d))
    return bm25.document_frequency(index.postings, index.stats).withColumn("idf", F.round("idf", 6))


@query(f"WITH {DOCS}, {TF} SELECT CAST(count(*) AS BIGINT) AS vocabulary_size FROM df")
def vocabulary_size(spark, d):
    return bm25.Bm25Index.build(docs(spark, d)).vocabulary_size()


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DOCS}, {_bm25(ITEM)} SELECT query_id, entry_id, round(score, 6) AS score, rank FROM bm WHERE rank <= {K}")
def bm25_topk(spark, d):
    return _ranked(bm25.Bm25Index.build(docs(spark, d)).search(first_item(spark, d), K))


@query(f"WITH {DOCS}, {_bm25('SELECT item_id AS query_id, text FROM benchmark')} SELECT query_id, entry_id, round(score, 6) AS score, rank FROM bm WHERE rank <= {K}")
def bm25_batch(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _ranked(bm25.Bm25Index.build(docs(spark, d)).search(asked, K))


@query(f"WITH docs AS (SELECT doc_id AS entry_id, text, source FROM documents), {_bm25(ITEM, "contains(lower(source), 'src1')")} SELECT query_id, entry_id, round(score, 6) AS score, rank FROM bm WHERE rank <= {K}")
def bm25_filtered(spark, d):
    allowed = commits(spark, d).where(SearchFilters(author=AUTHOR).predicate())
    return _ranked(bm25.Bm25Index.build(docs(spark, d)).search(first_item(spark, d), K, allowed))


# --- vectors ----------------------------------------------------------------------


@query(f"WITH {VECS}, {Q} SELECT entry_id, round({_dot('embedding', 'qv')}, 6) AS dot FROM vecs, q")
def vec_dot(spark, d):
    q = F.array(*(F.lit(float(x)) for x in first_vector(spark, d)))
    return vectors(spark, d).select("entry_id", F.round(V.dot(F.col("embedding"), q), 6).alias("dot"))


@query(f"WITH {VECS}, {Q} SELECT entry_id, round({_dot('embedding', 'qv')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('qv', 'qv')})), 6) AS cosine FROM vecs, q")
def vec_cosine(spark, d):
    q = F.array(*(F.lit(float(x)) for x in first_vector(spark, d)))
    return vectors(spark, d).select("entry_id", F.round(V.cosine(F.col("embedding"), q), 6).alias("cosine"))


@query(f"WITH {VECS} SELECT entry_id, unnest(range(0, len(embedding))) AS place, round(unnest(embedding)::DOUBLE / sqrt({_dot('embedding', 'embedding')}), 6) AS value FROM vecs")
def vec_normalize(spark, d):
    unit = vectors(spark, d).select("entry_id", F.posexplode(V.normalize(F.col("embedding"))).alias("place", "value"))
    return unit.select("entry_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query(f"WITH {VECS}, {_knn('vecs')} SELECT entry_id, dist, round(1 - dist, 6) AS similarity FROM near WHERE rank <= {K}")
def knn_exact(spark, d):
    return knn.knn(vectors(spark, d), first_vector(spark, d), K)


@query(f"WITH {VECS}, {_knn('vecs', 'label = 3')} SELECT entry_id, dist, round(1 - dist, 6) AS similarity FROM near WHERE rank <= {K}")
def knn_exact_filtered(spark, d):
    return knn.knn(vectors(spark, d), first_vector(spark, d), K, F.col("label") == 3)


@query(f"WITH {VECS}, {_knn('vecs')} SELECT max(dist) AS worst FROM near WHERE rank <= {K}")
def knn_worst(spark, d):
    return knn.knn_worst(knn.knn(vectors(spark, d), first_vector(spark, d), K), K)


@query(f"""WITH {VECS}, asked AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE label = 7)
SELECT query_id, entry_id, dist, rank FROM (
  SELECT query_id, entry_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, entry_id) AS rank
  FROM (SELECT query_id, entry_id, round(1 - {_dot('embedding', 'qv')}, 6) + 0.0 AS dist FROM vecs, asked)) WHERE rank <= {K}""")
def knn_batch(spark, d):
    asked = table(spark, d, "embeddings").where("label = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.knn_batch(vectors(spark, d), asked, K).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VECS}, {Q} SELECT entry_id, round({_dot('embedding', 'qv')}, 6) AS similarity FROM vecs, q WHERE entry_id = 17")
def similarity_by_id(spark, d):
    return knn.similarity(vectors(spark, d), 17, first_vector(spark, d))


@query(f"""WITH {VECS}, longer AS (SELECT entry_id, list_resize(embedding::DOUBLE[], 80, 0.0::DOUBLE) AS v FROM vecs), shorter AS (SELECT entry_id, (embedding::DOUBLE[])[1:10] AS v FROM vecs)
SELECT entry_id, len(v)::BIGINT AS dim, place, round(v[place + 1], 6) AS value FROM (SELECT *, unnest(range(0, len(v))) AS place FROM (SELECT * FROM longer UNION ALL SELECT * FROM shorter))""")
def vec_fit_dimension(spark, d):
    rows = vectors(spark, d)
    both = [rows.select("entry_id", F.lit(n).cast("long").alias("dim"), F.posexplode(V.fit_dimension(F.col("embedding"), n)).alias("place", "value")) for n in (80, 10)]
    return both[0].unionByName(both[1]).select("entry_id", "dim", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


def _graphs(spark, d) -> tuple[DataFrame, DataFrame, int]:
    rows = vectors(spark, d)
    shards = hnsw.shards_for(rows.count())
    return rows, hnsw.build_graphs(rows, shards), shards


_NEAR = "SELECT 0::BIGINT AS query_id, entry_id, dist, rank FROM near WHERE rank <= "


@query(f"WITH {VECS}, {_knn('vecs')} {_NEAR} {K}")
def knn_approx(spark, d):
    """By the graphs; the SQL is the exact answer, which a search of the default
    width has to meet in all of its first places."""
    rows, graphs, shards = _graphs(spark, d)
    near, _ = hnsw.search_escalating(graphs, rows, first_vector(spark, d), K, rows.count(), shards=shards)
    return near.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VECS}, {_knn('vecs', 'label = 3')} {_NEAR} {K}")
def knn_approx_filtered(spark, d):
    rows, graphs, shards = _graphs(spark, d)
    some = rows.where("label = 3")
    near, _ = hnsw.search_escalating(graphs, some, first_vector(spark, d), K, some.count(), filtered=True, shards=shards)
    return near.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT count(*)::BIGINT AS queries, true AS recall_reached FROM embeddings WHERE label = 7")
def knn_approx_recall(spark, d):
    """Of the true K nearest of many queries, the graphs find 0.95 at default width."""
    rows, graphs, shards = _graphs(spark, d)
    asked = rows.where("label = 7").select(F.col("entry_id").alias("query_id"), "embedding")
    true, found = knn.knn_batch(rows, asked, K), hnsw.search_graphs(graphs, asked, K, shards=shards)
    hits = true.join(found.select("query_id", "entry_id", F.lit(1).alias("hit")), ["query_id", "entry_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("recall_reached"))


# --- fusion and diversity -----------------------------------------------------------


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hybrid corpus; semantic ranking by vector 0; lexical by the first item."""
    corpus = hybrid(spark, d)
    asked = spark.createDataFrame([(0, [float(x) for x in first_vector(spark, d)])], "query_id long, embedding array<double>")
    n = depth(K, Mode.HYBRID, False)
    semantic = knn.knn_batch(corpus.select("entry_id", "embedding"), asked, n)
    lexical = bm25.Bm25Index.build(corpus.select("entry_id", "text")).search(first_item(spark, d), n)
    return corpus, semantic, lexical


_BOTH = f"WITH {HYBRID}, {_bm25(ITEM)}, {_knn('docs')}"
_FUSED = f"""fused AS (
  SELECT entry_id, rrf, row_number() OVER (ORDER BY rrf DESC, entry_id) AS rank FROM (
    SELECT coalesce(s.entry_id, l.entry_id) AS entry_id,
      coalesce(CAST(1.0::DOUBLE / (60 + s.rank) AS REAL), 0::REAL) + coalesce(CAST(1.0::DOUBLE / (60 + l.rank) AS REAL), 0::REAL) AS rrf
    FROM (SELECT * FROM near WHERE rank <= 50) s FULL JOIN (SELECT * FROM bm WHERE rank <= 50) l ON s.entry_id = l.entry_id))"""


@query(f"{_BOTH}, {_FUSED} SELECT 0::BIGINT AS query_id, entry_id, round(rrf::DOUBLE, 6) AS rrf, rank FROM fused WHERE rank <= {K}")
def rrf_fuse(spark, d):
    _, semantic, lexical = _sides(spark, d)
    return fusion.rrf([semantic, lexical], K).select("query_id", "entry_id", F.round(F.col("rrf").cast("double"), 6).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query(f"""{_BOTH}, third AS (SELECT entry_id, row_number() OVER (ORDER BY length(text) DESC, entry_id) AS rank FROM docs),
parts AS (
  SELECT entry_id, CAST(1.0::DOUBLE / (60 + rank) AS REAL) AS a, 0::REAL AS b, 0::REAL AS c FROM near WHERE rank <= 50
  UNION ALL SELECT entry_id, 0::REAL, CAST(1.0::DOUBLE / (60 + rank) AS REAL), 0::REAL FROM bm WHERE rank <= 50
  UNION ALL SELECT entry_id, 0::REAL, 0::REAL, CAST(1.0::DOUBLE / (60 + rank) AS REAL) FROM third WHERE rank <= 50),
fused AS (SELECT entry_id, max(a) + max(b) + max(c) AS rrf FROM parts GROUP BY entry_id)
SELECT entry_id, round(rrf::DOUBLE, 6) AS rrf, row_number() OVER (ORDER BY rrf DESC, entry_id) AS rank FROM fused QUALIFY rank <= {K}""")
def rrf_three_way(spark, d):
    corpus, semantic, lexical = _sides(spark, d)
    from pyspark.sql import Window

    longest = corpus.orderBy(F.desc(F.char_length("text")), "entry_id").limit(50)
    third = longest.select(F.lit(0).cast("long").alias("query_id"), "entry_id", F.row_number().over(Window.orderBy(F.desc(F.char_length("text")), "entry_id")).alias("rank"))
    return fusion.rrf([semantic, lexical, third], K).select("entry_id", F.round(F.col("rrf").cast("double"), 6).alias("rrf"), F.col("rank").cast("long").alias("rank"))


def _mmr_sql(pool: str, k: int) -> str:
    """k unrolled steps over pool(entry_id, position, relevance, embedding)."""
    out = f"{pool}, pick1 AS (SELECT *, 1 AS step FROM pool ORDER BY position LIMIT 1)"
    for i in range(2, k + 1):
        out += f""", pick{i} AS (
  SELECT p.*, {i} AS step FROM pool p WHERE p.entry_id NOT IN (SELECT entry_id FROM chosen{i - 1})
  ORDER BY round(0.7 * p.relevance - 0.3 * (SELECT max(s.sim) FROM sims s JOIN chosen{i - 1} c ON c.entry_id = s.b WHERE s.a = p.entry_id), 9) DESC, p.position LIMIT 1)"""
        out = out.replace(f", pick{i} AS", f", chosen{i - 1} AS MATERIALIZED (SELECT * FROM pick1{''.join(f' UNION ALL SELECT * FROM pick{j}' for j in range(2, i))}), pick{i} AS", 1)
    return out + f" SELECT entry_id, step::BIGINT AS rank FROM (SELECT * FROM chosen{k - 1} UNION ALL SELECT * FROM pick{k})"


_SIMS = f"sims AS MATERIALIZED (SELECT x.entry_id AS a, y.entry_id AS b, {_dot('x.embedding', 'y.embedding')} AS sim FROM pool x, pool y)"


@query(f"WITH {VECS}, {_knn('vecs')}, " + _mmr_sql(f"pool AS MATERIALIZED (SELECT near.entry_id, near.rank AS position, greatest(0.0, least(1.0, 1 - dist)) AS relevance, embedding FROM near JOIN vecs USING (entry_id) WHERE near.rank <= 50), {_SIMS}", K))
def mmr_rerank(spark, d):
    asked = spark.createDataFrame([(0, [float(x) for x in first_vector(spark, d)])], "query_id long, embedding array<double>")
    near = knn.knn_batch(vectors(spark, d), asked, 50)
    pool = near.join(vectors(spark, d), "entry_id").select("query_id", "entry_id", F.col("rank").alias("position"), (1 - F.col("dist")).alias("relevance"), "embedding")
    return mmr.mmr(pool, K).select("entry_id", F.col("rank").cast("long").alias("rank"))


def _hybrid_sql(best: str) -> str:
    return f"SELECT b.entry_id, b.rank, source, round(1 - n.dist, 6) AS similarity FROM {best} b JOIN docs USING (entry_id) LEFT JOIN (SELECT * FROM near WHERE rank <= 50) n USING (entry_id) WHERE b.rank <= {K}"


def _attach(best: DataFrame, corpus: DataFrame, semantic: DataFrame | None) -> DataFrame:
    found = corpus.select("entry_id", "source").join(F.broadcast(best.select("entry_id", F.col("rank").cast("long").alias("rank"))), "entry_id")
    if semantic is None:
        return found.select("entry_id", "rank", "source", F.lit(None).cast("double").alias("similarity"))
    near = semantic.select("entry_id", F.round(1 - F.col("dist"), 6).alias("similarity"))
    return found.join(F.broadcast(near), "entry_id", "left").select("entry_id", "rank", "source", "similarity")


@query(f"{_BOTH}, {_FUSED} {_hybrid_sql('fused')}")
def hybrid_search(spark, d):
    corpus, semantic, lexical = _sides(spark, d)
    best = hybrid_ranking(semantic, lexical, depth(K, Mode.HYBRID, False)).where(F.col("rank") <= K)
    return _attach(best, corpus, semantic)


@query(f"{_BOTH} {_hybrid_sql('near')}")
def semantic_search(spark, d):
    corpus, semantic, _ = _sides(spark, d)
    return _attach(hybrid_ranking(semantic, None, K), corpus, semantic)


@query(f"{_BOTH} SELECT b.entry_id, b.rank, source, NULL::DOUBLE AS similarity FROM bm b JOIN docs USING (entry_id) WHERE b.rank <= {K}")
def lexical_search(spark, d):
    corpus, _, lexical = _sides(spark, d)
    return _attach(hybrid_ranking(None, lexical, K), corpus, None)


@query(f"{_BOTH}, {_FUSED}, " + _mmr_sql(f"""pool AS MATERIALIZED (
  SELECT f.entry_id, f.rank AS position, embedding,
    greatest(0.0, least(1.0, coalesce(1 - n.dist, 1.0 - (f.rank - 1)::DOUBLE / (SELECT count(*) FROM fused WHERE rank <= 50)))) AS relevance
  FROM fused f JOIN docs USING (entry_id) LEFT JOIN (SELECT * FROM near WHERE rank <= 50) n USING (entry_id) WHERE f.rank <= 50), {_SIMS}""", K))
def hybrid_diverse(spark, d):
    corpus, semantic, lexical = _sides(spark, d)
    ranking = hybrid_ranking(semantic, lexical, depth(K, Mode.HYBRID, True))
    return diversify(ranking, semantic, corpus, K, mmr.LAMBDA).select("entry_id", F.col("rank").cast("long").alias("rank"))


# --- index ----------------------------------------------------------------------------


_HALF = "(SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM documents)"


@query(f"""WITH {COMMITS}, walk AS (SELECT *, entry_id AS walk_pos FROM commits)
SELECT walk_pos, hash FROM walk WHERE walk_pos < (SELECT min(walk_pos) FROM walk WHERE hash = (SELECT hash FROM walk WHERE walk_pos = {_HALF}))""")
def incremental_since(spark, d):
    walk = commits(spark, d).withColumnRenamed("entry_id", "walk_pos")
    half = walk.count() // 2
    return git.since(walk, walk.where(F.col("walk_pos") == half).first().hash).select("walk_pos", "hash")


@query(f"""WITH {COMMITS}, old AS (SELECT entry_id, hash FROM commits WHERE entry_id < {_HALF}),
fresh AS (SELECT hash, min(entry_id) AS pos FROM commits WHERE hash NOT IN (SELECT hash FROM old) GROUP BY hash)
SELECT entry_id, hash FROM old
UNION ALL SELECT (SELECT max(entry_id) + 1 FROM old) + row_number() OVER (ORDER BY pos) - 1, hash FROM fresh""")
def incremental_merge(spark, d):
    rows = commits(spark, d).select("entry_id", "hash")
    half = rows.count() // 2
    new = rows.withColumnRenamed("entry_id", "walk_pos")  # overlaps with all that is indexed
    return merge.merge_new(rows.where(F.col("entry_id") < half), new)


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{git_folder(spark)}/{name}-{uuid.uuid4().hex}"


def git_folder(spark: SparkSession) -> str:
    """A folder that the session shares; one of its own only in a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _engine(spark: SparkSession, d: str) -> Engine:
    engine = Engine(spark, _fresh(spark, "index"), HashedEmbedder())
    engine.build(commits(spark, d).withColumnRenamed("entry_id", "walk_pos"))
    return engine


@query(f"WITH {COMMITS} SELECT entry_id, hash, author, date, message, diff_summary FROM commits")
def index_roundtrip(spark, d):
    return _engine(spark, d).storage.load()[0].drop("embedding")


@query(f"WITH {COMMITS} SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT author) AS BIGINT) AS authors, min(date) AS oldest, max(date) AS newest, 'hashed-64' AS model, true AS include_diffs FROM commits")
def index_stats(spark, d):
    return _engine(spark, d).stats().select("entries", "authors", "oldest", "newest", "model", "include_diffs")


# The lexical search of an index over the commits' whole texts.
_INDEXED = f"WITH {COMMITS}, docs AS (SELECT entry_id, message || chr(10) || author || chr(10) || diff_summary AS text FROM commits), {_bm25(ITEM)}, hits AS (SELECT c.*, bm.rank FROM bm JOIN commits c USING (entry_id) WHERE bm.rank <= {K})"
_SUBJECT = r"regexp_replace(split_part(message, chr(10), 1), '\r$', '')"


def _lexical(spark, d):
    text = first_item(spark, d).first().text
    return text, _engine(spark, d).search(SearchRequest(text, K, mode=Mode.LEXICAL))


@query(rf"""{_INDEXED} SELECT (SELECT text FROM benchmark ORDER BY item_id LIMIT 1) AS query, 'lexical' AS mode, 'exact' AS strategy,
  (SELECT count(*) FROM commits) AS candidates, false AS diversified, rank, hash, author, strftime(date, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date, {_SUBJECT} AS subject,
  regexp_replace(message, '\s+$', '') AS message, array_to_string({_FILES}, '|') AS files, NULL::DOUBLE AS similarity FROM hits""")
def json_results(spark, d):
    """The JSON document of a search, read back into rows (all but the time taken)."""
    text, o = _lexical(spark, d)
    found = json_document(o.results, text, o.mode.value, o.strategy.value, o.candidates, o.diversified, o.took_ms)
    result = "struct<rank:long,hash:string,author:string,date:string,subject:string,message:string,files:array<string>,similarity:double>"
    read = found.select(F.from_json("json", f"query string, mode string, strategy string, candidates long, diversified boolean, took_ms double, results array<{result}>").alias("j"))
    rows = read.where("j.took_ms >= 0").select("j.query", "j.mode", "j.strategy", "j.candidates", "j.diversified", F.explode("j.results").alias("r")).select("*", "r.*").drop("r")
    return rows.withColumn("files", F.array_join("files", "|"))


@query(rf"""{_INDEXED}, parts AS (SELECT rank, rank || '. ' || left(hash, 7) || ' ' || {_SUBJECT} || ' (keyword match)' AS a, '   ' || author || ', ' || strftime(date, '%Y-%m-%d') AS b,
  '   ' || array_to_string(string_split(diff_summary, chr(10))[1:2], chr(10) || '   ') AS c FROM hits)
SELECT (rank - 1) * 4 + unnest([0, 1, 2, 3]) AS place, unnest([a, b, c, '']) AS line FROM parts""")
def text_results(spark, d):
    lines = text_lines(_lexical(spark, d)[1].results)
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


@query(f"""WITH {DOCS}, t AS (SELECT entry_id, ('0x' || left(md5(t), 8))::BIGINT AS h FROM (SELECT entry_id, unnest({_tokens("text")}) AS t FROM docs)),
c AS (SELECT entry_id, (h >> 1) % 64 AS place, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n FROM t GROUP BY ALL),
u AS (SELECT entry_id, sqrt(sum(n * n)) AS size FROM c GROUP BY entry_id)
SELECT entry_id, place, (n / size)::REAL::DOUBLE AS value FROM c JOIN u USING (entry_id) WHERE n <> 0""")
def embed_text(spark, d):
    """A stand-in without meaning; the model's path is a setting."""
    made = HashedEmbedder().embed(docs(spark, d), "text").select("entry_id", F.posexplode("embedding").alias("place", "value"))
    return made.where("value <> 0").select("entry_id", F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value"))


# --- a repository made of the commits ----------------------------------------------------


#: Commits of a run that build on each other's files.
RUN = 16
#: Texts that one task writes as a pack of objects.
PACK_ROWS = 4096


def repository(spark: SparkSession, d: str) -> str:
    """A repository with a commit per row, in the order of ids: each adds a file
    with its text, so that the newest is first in the walk.

    Commits come in runs. The first of a run merges the one before it into the root, so
    that it adds its file to the root's; the others add theirs to what the run has. A
    single line of commits would have a folder of all files before in each of them,
    which is quadratic. Tasks write the texts, each a pack; one process
    writes the commits, which only name them."""
    where = Path(_fresh(spark, "repository").removeprefix("file://"))
    where.mkdir(parents=True)
    git_ = ["git", "-c", "safe.directory=*", "-c", "fastimport.unpackLimit=0", "-c", "core.compression=1", "-C", str(where)]
    run = lambda *a: subprocess.run([*git_, *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    data = lambda b: b"data %d\n" % len(b) + b + b"\n"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = None
        for batch in batches:
            if load is None:
                load = subprocess.Popen([*git_, "fast-import", "--quiet"], stdin=subprocess.PIPE, env=os.environ | {"HOME": str(where)})
            names = []
            for text in batch.column("message"):
                blob = text.as_py().encode() + b"\n"
                names.append(hashlib.sha1(b"blob %d\0" % len(blob) + blob).hexdigest())
                load.stdin.write(b"blob\n" + data(blob))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string())], names=[*batch.schema.names[:-1], "blob"])
        if load is not None:
            load.stdin.close()
            if load.wait():
                raise OSError("the texts could not be written")

    rows = commits(spark, d).select("entry_id", "author", F.unix_timestamp("date").alias("at"), T.subject(F.col("message")).alias("subject"), "message")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PACK_ROWS))
    listed = _fresh(spark, "blobs")
    rows.repartitionByRange(parts, "entry_id").sortWithinPartitions("entry_id").mapInArrow(write, "entry_id long, author string, at long, subject string, blob string").write.parquet(listed)
    load = subprocess.Popen([*git_, "-c", "core.compression=0", "fast-import", "--quiet", "--depth=0"], stdin=subprocess.PIPE, env=os.environ | {"HOME": str(where)})
    files = sorted(Path(listed.removeprefix("file://")).glob("*.parquet"))  # a short row per commit, in the order of ranges
    for i, (entry_id, author, at, subject, blob) in enumerate(row for f in files for row in zip(*(c.to_pylist() for c in pq.read_table(f).columns))):
        who = f"{author} <a@example.org> {at} +0000\n".encode()
        parent = b""
        if i and i % RUN == 1:
            parent = b"from :1\nmerge :2\n" if i > 1 else b"from :1\n"
        load.stdin.write(b"commit refs/heads/main\nmark :%d\nauthor " % (2 if i else 1) + who + b"committer " + who + data(subject.encode()) + parent + f"M 100644 {blob} docs/{entry_id}.txt\n".encode())
    load.stdin.close()
    if load.wait():
        raise OSError("the repository could not be written")
    run("multi-pack-index", "write")  # a look-up of an object is one for all packs
    return str(where)


_TEXT = "'Files: docs/' || entry_id || '.txt' || chr(10) || '+' || replace(message, chr(10), chr(10) || '+') || chr(10)"
_CUT = f"""CASE WHEN strlen(t) <= {T.TEXT_LIMIT} THEN t ELSE left(t, (SELECT min(i) FROM (SELECT unnest(range({T.TEXT_LIMIT} // 4, {T.TEXT_LIMIT} + 1)) AS i) WHERE strlen(left(t, i)) >= {T.TEXT_LIMIT})) || chr(10) || '... (truncated)' END"""
_HISTORY = f"""{COMMITS}, walked AS (
  SELECT (SELECT max(entry_id) FROM commits) - entry_id AS walk_pos, author, date_trunc('second', date) AS date, {_SUBJECT} AS subject, {_TEXT} AS t FROM commits)"""


@query(f"WITH {_HISTORY} SELECT walk_pos, author, date, subject, {_CUT} AS diff_summary FROM walked")
def git_history(spark, d):
    rows = git.history(spark, repository(spark, d))
    return rows.select("walk_pos", "author", "date", T.subject(F.col("message")).alias("subject"), "diff_summary")


@query(f"WITH {COMMITS} SELECT (SELECT max(entry_id) FROM commits) - entry_id AS walk_pos, {_SUBJECT} AS subject, '' AS diff_summary FROM commits WHERE entry_id > {_HALF}")
def git_history_since(spark, d):
    """The walk before the commit in its middle, without changes."""
    where = repository(spark, d)
    hashes = git.walk(where)
    half = len(hashes) - 1 - table(spark, d, "documents").count() // 2
    found = git.since(git.history(spark, where, include_diffs=False), hashes[half])
    return found.select("walk_pos", T.subject(F.col("message")).alias("subject"), "diff_summary")


# --- the index over time -------------------------------------------------------------------

_WALK = f"""{COMMITS}, old AS (SELECT * FROM commits WHERE entry_id >= {_HALF}),
stop AS (SELECT min(entry_id) AS pos FROM commits WHERE hash = (SELECT hash FROM commits WHERE entry_id = {_HALF})),
n AS (SELECT (SELECT count(*) FROM old) AS half, (SELECT count(DISTINCT hash) FROM commits WHERE entry_id < (SELECT pos FROM stop) AND hash NOT IN (SELECT hash FROM old)) AS fresh, (SELECT count(*) FROM commits) AS whole)"""


@query(f"""WITH {_WALK}
SELECT 1::BIGINT AS step, 'rebuilt' AS done, half AS commits, false AS include_diffs, true AS fresh_fingerprint FROM n
UNION ALL SELECT 2, 'refused', half, false, false FROM n
UNION ALL SELECT 3, 'current', half, false, false FROM n
UNION ALL SELECT 4, 'updated', half + fresh, false, true FROM n
UNION ALL SELECT 5, 'current', half + fresh, false, false FROM n
UNION ALL SELECT 6, 'rebuilt', whole, true, true FROM n
UNION ALL SELECT 7, 'current', whole, true, false FROM n""")
def index_lifecycle(spark, d):
    """The older half indexed quickly, full asked without force, again, the rest
    appended, again, rebuilt with changes by force, and quick asked of that."""
    walk = commits(spark, d).withColumnRenamed("entry_id", "walk_pos")
    older = walk.where(F.col("walk_pos") >= table(spark, d, "documents").count() // 2)
    engine = Engine(spark, _fresh(spark, "index"), HashedEmbedder())
    rows, before = [], ""
    for i, (source, how) in enumerate([(older, {"quick": True}), (older, {"full": True}), (older, {"quick": True}), (walk, {"quick": True}), (walk, {"quick": True}), (walk, {"full": True, "force": True}), (walk, {"quick": True})]):
        meta, done = engine.index(source, **how)
        rows.append((i + 1, done, meta.total_commits, meta.include_diffs, meta.fingerprint != before))
        before = meta.fingerprint
    return spark.createDataFrame(rows, "step long, done string, commits long, include_diffs boolean, fresh_fingerprint boolean")


@query("""SELECT * FROM (VALUES ('new', true, 5), ('kept', false, 5), ('stale', true, 5), ('file lost', true, 5), ('file damaged', true, 5), ('marker damaged', true, 5), ('kept', false, 5), ('cannot be stored', true, 5)) v(state, built, rows)""")
def derived_recovery(spark, d):
    """What becomes of a derived table that is missing, stale or damaged."""
    storage = _engine(spark, d).storage
    meta, rows = storage.meta(), []
    folder = Path(f"{storage.where}/{meta.snapshot}")
    newest = lambda: max(folder.glob("probe-*"), key=lambda p: p.stat().st_mtime_ns)

    def see(state: str, name: str = "probe") -> None:
        found, built = storage.derived(name, meta, lambda: spark.range(5).coalesce(1))
        rows.append((state, built, found.count()))

    see("new")
    see("kept")
    meta.fingerprint += "x"
    see("stale")
    next(newest().glob("*.parquet")).unlink()
    see("file lost")
    next(newest().glob("*.parquet")).write_bytes(b"PAR1")
    see("file damaged")
    (folder / "probe.json").write_text("{")
    see("marker damaged")
    see("kept")
    (folder / "blocked").write_text("no folder")
    see("cannot be stored", "blocked/x")
    return spark.createDataFrame(rows, "state string, built boolean, rows int")


@query("""WITH g AS (SELECT * FROM (VALUES ('hybrid'), ('semantic'), ('lexical')) m(asked), (VALUES (3), (40)) k(k), (VALUES (true), (false)) d(diverse), (VALUES (true), (false)) e(exact),
  (VALUES (100), (2048), (2049)) c(candidates), (VALUES (true), (false)) u(graph), (VALUES (true), (false)) w(words)),
r AS (SELECT *, CASE WHEN words THEN asked ELSE 'semantic' END AS mode FROM g)
SELECT asked, k, diverse, exact, candidates, graph, words, mode, CASE WHEN mode = 'hybrid' OR diverse THEN greatest(4 * k, 50) ELSE k END AS depth,
  graph AND NOT exact AND candidates > 2048 AS use_graph FROM r""")
def planner_table(spark, d):
    """What is planned for each combination of a request and of what is there."""
    rows = []
    for mode in Mode:
        for k in (3, 40):
            for bits in range(16):
                diverse, exact, graph, words = (bool(bits >> i & 1) for i in range(4))
                for candidates in (100, 2048, 2049):
                    p = planner.plan(k, mode, diverse, exact, candidates, graph, words)
                    rows.append((mode.value, k, diverse, exact, candidates, graph, words, p.mode.value, p.depth, p.use_graph))
    return spark.createDataFrame(rows, "asked string, k int, diverse boolean, exact boolean, candidates int, graph boolean, words boolean, mode string, depth int, use_graph boolean")


@query("""SELECT * FROM (VALUES ('2024-01-31', 'ok'), ('2024-1-5', 'ok'), ('2024-02-30', 'E4001'), ('31.01.2024', 'E4001'), ('', 'E4001'), ('2024-01-31T00:00:00', 'E4001')) v(given, outcome)""")
def filter_dates_checked(spark, d):
    """Dates are refused before anything runs."""
    rows = []
    for given in ("2024-01-31", "2024-1-5", "2024-02-30", "31.01.2024", "", "2024-01-31T00:00:00"):
        try:
            SearchFilters(after=given).apply(commits(spark, d))
            rows.append((given, "ok"))
        except errors.InvalidDateFormat as e:
            rows.append((given, e.code))
    return spark.createDataFrame(rows, "given string, outcome string")


@query(r"""SELECT * FROM (VALUES (1, 'open https://host/a/b#top'), (2, 'in ~\Documents\x'), (3, 'plain'), (4, 'http://h/p twice http://h/q')) v(n, message)""")
def errors_sanitised(spark, d):
    said = ["open https://host/a/b?key=secret#top", r"in C:\Users\someone\Documents\x", "plain", "http://h/p?x=1 twice http://h/q?y=2"]
    return spark.createDataFrame([(i + 1, errors.sanitize(m)) for i, m in enumerate(said)], "n int, message string")
