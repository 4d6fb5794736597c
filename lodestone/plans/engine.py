"""The engine: index a history or a table, search it, report on it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.embed import Embedder, HashedEmbedder
from lodestone.errors import CommitNotFound, EmptyIndex
from lodestone.functions.text import doc_text
from lodestone.functions.vectors import normalize
from lodestone.operators import bm25, fusion, hnsw, knn, mmr
from lodestone.operators.filters import SearchFilters
from lodestone.operators.merge import fresh_rows, numbered
from lodestone.plans import planner
from lodestone.plans.planner import Mode, Strategy
from lodestone.sources import git
from lodestone.sources.snapshots import IndexMeta, IndexStorage

@dataclass(frozen=True)
class SearchRequest:
    query: str
    k: int = 10
    filters: SearchFilters = field(default_factory=SearchFilters)
    mode: Mode = Mode.HYBRID
    exact: bool = False
    ef: int | None = None
    diverse: bool = False
    weight: float = mmr.LAMBDA


@dataclass
class SearchOutcome:
    results: DataFrame  # rank, similarity and the entry's columns
    strategy: Strategy
    candidates: int
    mode: Mode
    diversified: bool
    took_ms: float


def hybrid_ranking(semantic: DataFrame | None, lexical: DataFrame | None, depth: int) -> DataFrame:
    """query_id, entry_id, rank of one or both rankings(query_id, entry_id, rank)."""
    sides = [s.select("query_id", "entry_id", "rank") for s in (semantic, lexical) if s is not None]
    if len(sides) == 1:
        return sides[0].where(F.col("rank") <= depth)
    return fusion.rrf(sides, depth).select("query_id", "entry_id", "rank")


def diversify(ranking: DataFrame, semantic: DataFrame | None, entries: DataFrame, k: int, weight: float) -> DataFrame:
    """MMR over a ranking. An entry's relevance is its similarity, or where it has
    none, 1 less its relative place."""
    pool = ranking.join(F.broadcast(ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))), "query_id")
    if semantic is not None:
        pool = pool.join(semantic.select("query_id", "entry_id", (1 - F.col("dist")).alias("sim")), ["query_id", "entry_id"], "left")
    else:
        pool = pool.withColumn("sim", F.lit(None).cast("double"))
    placed = F.lit(1.0) - (F.col("rank") - 1) / F.col("n")
    rows = pool.join(entries.select("entry_id", "embedding"), "entry_id")
    return mmr.mmr(rows.select("query_id", "entry_id", F.col("rank").alias("position"), F.coalesce("sim", placed).alias("relevance"), "embedding"), k, weight)


class Engine:
    def __init__(self, spark: SparkSession, index_path: str, embedder: Embedder | None = None, exact_limit: int = planner.EXACT_LIMIT):
        self.spark, self.embedder, self.exact_limit = spark, embedder or HashedEmbedder(), exact_limit
        self.storage = IndexStorage(spark, index_path)

    # --- building -----------------------------------------------------------

    def init(self, force: bool = False) -> None:
        """Check the embedder; with ``force`` its files are read again, whatever
        this process has found before."""
        if force:
            self.embedder.forget()
        self.embedder.validate()

    def _entries(self, commits: DataFrame, include_diffs: bool) -> DataFrame:
        text = doc_text(F.col("message"), F.col("author"), F.col("diff_summary"), include_diffs)
        rows = self.embedder.embed(commits.withColumn("__text", text), "__text").drop("__text")
        return rows.withColumn("embedding", normalize(F.col("embedding")).cast("array<float>"))

    def build(self, commits: DataFrame, include_diffs: bool = True, created_at: str = "") -> IndexMeta:
        """Full index of commits(walk_pos, hash, author, date, message, diff_summary)."""
        rows = commits if include_diffs else commits.withColumn("diff_summary", F.lit(""))
        newest = rows.orderBy("walk_pos").select("hash").limit(1).collect()
        meta = IndexMeta(self.embedder.name, newest[0].hash if newest else "unknown", created_at, include_diffs=include_diffs)
        meta = self.storage.save(self._entries(numbered(rows, "walk_pos").drop("walk_pos"), include_diffs), meta)
        self._derive(meta, True)
        return meta

    def append(self, commits: DataFrame) -> IndexMeta:
        """Incremental index: what the walk has before the last indexed commit."""
        entries, meta = self.storage.load()
        new = git.since(commits, meta.last_commit)
        if not meta.include_diffs:
            new = new.withColumn("diff_summary", F.lit(""))
        newest = new.orderBy("walk_pos").select("hash").limit(1).collect()
        if not newest:
            return meta
        meta.last_commit = newest[0].hash
        return self.append_rows(entries, meta, new)

    def append_rows(self, entries: DataFrame, meta: IndexMeta, rows: DataFrame) -> IndexMeta:
        """Only rows that are new are embedded, after they were numbered."""
        fresh = self._entries(fresh_rows(entries, rows), meta.include_diffs)
        meta = self.storage.save(entries.unionByName(fresh.select(*entries.columns)), meta)
        self._derive(meta, True)
        return meta

    def index(self, commits: DataFrame, quick: bool = False, full: bool = False, force: bool = False) -> tuple[IndexMeta, str]:
        """What was done: rebuilt, updated, current, or refused (an index without
        diffs gets none without force)."""
        diffs = full or not quick
        if force or not self.storage.exists():
            return self.build(commits, diffs), "rebuilt"
        meta = self.storage.meta()
        if full and not meta.include_diffs:
            return meta, "refused"
        before = meta.last_commit
        try:
            meta = self.append(commits)
        except CommitNotFound:
            return self.build(commits, meta.include_diffs, meta.created_at), "rebuilt"
        return meta, "updated" if meta.last_commit != before else "current"

    def index_repository(self, path: str, quick: bool = False, full: bool = False, force: bool = False) -> tuple[IndexMeta, str]:
        diffs = full or not quick
        if self.storage.exists() and not force:
            diffs = self.storage.meta().include_diffs
        return self.index(git.history(self.spark, path, diffs), quick, full, force)

    def _derive(self, meta: IndexMeta, refresh: bool = False) -> dict[str, DataFrame]:
        if not meta.total_commits:
            return {}
        entries = self.storage.load()[0]
        docs = entries.select("entry_id", doc_text(F.col("message"), F.col("author"), F.col("diff_summary")).alias("text"))
        words = bm25.Bm25Index.build(docs)
        shards = hnsw.shards_for(meta.total_commits)
        tables: dict[str, DataFrame] = {}
        # Lengths are sums over the postings just stored, so that each text is tokenized once.
        plans = {"postings": lambda: words.postings.sortWithinPartitions("term"), "doc_lengths": lambda: bm25.lengths_of(tables["postings"], docs)}
        if meta.total_commits > self.exact_limit:
            plans["graphs"] = lambda: hnsw.build_graphs(entries, shards)
        for name, build in plans.items():
            tables[name] = self.storage.derived(name, meta, build, refresh)[0]
        return tables

    # --- searching ----------------------------------------------------------

    def search(self, request: SearchRequest) -> SearchOutcome:
        began = time.perf_counter()
        predicate = request.filters.predicate()  # dates are checked before all else
        entries, meta = self.storage.load()
        if not meta.total_commits:
            raise EmptyIndex()
        tables = self._derive(meta)
        active = request.filters.is_active()
        allowed = entries.where(predicate) if active else entries
        candidates = allowed.count() if active else meta.total_commits
        mode = Mode(request.mode)
        query = self.embedder.embed(self.spark.createDataFrame([(0, request.query)], "query_id long, text string"), "text")
        vector = [float(x) for x in query.select(normalize(F.col("embedding")).alias("v")).first().v]
        usable = False
        if "graphs" in tables and not request.exact:
            size = tables["graphs"].agg(F.sum("nodes").alias("n"), F.max("dim").alias("d")).first()
            usable = planner.graph_usable(size.n, size.d, meta.total_commits, len(vector))
        p = planner.plan(request.k, mode, request.diverse, request.exact, candidates, usable, "postings" in tables, self.exact_limit)
        strategy, semantic, lexical = Strategy.EXACT, None, None
        if p.mode.uses_vectors:
            semantic, strategy = self._nearest(allowed if active else None, entries, tables.get("graphs"), vector, p, request.ef, candidates, meta)
        if p.mode.uses_words:
            index = bm25.Bm25Index(tables["postings"], tables["doc_lengths"])
            lexical = index.search(query.select("query_id", "text"), p.depth, allowed if active else None)
        ranking = hybrid_ranking(semantic, lexical, p.depth)
        if request.diverse:
            best = diversify(ranking, semantic, entries, request.k, request.weight)
        else:
            best = ranking.where(F.col("rank") <= request.k)
        results = entries.join(F.broadcast(best.select("entry_id", "rank")), "entry_id")
        if semantic is not None:
            near = semantic.select("entry_id", F.round(1 - F.col("dist"), 6).alias("similarity"))
            results = results.join(F.broadcast(near), "entry_id", "left")
        else:
            results = results.withColumn("similarity", F.lit(None).cast("double"))
        rows = results.drop("embedding").collect()  # at most k
        kept = self.spark.createDataFrame(rows, results.drop("embedding").schema).orderBy("rank")
        return SearchOutcome(kept, strategy, candidates, p.mode, request.diverse, (time.perf_counter() - began) * 1000)

    def _nearest(self, allowed, entries, graphs, vector, p, ef, candidates, meta) -> tuple[DataFrame, Strategy]:
        strategy = Strategy.EXACT
        if p.use_graph:
            near, enough = hnsw.search_escalating(graphs, allowed if allowed is not None else entries, vector, p.depth, candidates, ef, allowed is not None, hnsw.shards_for(meta.total_commits))
            return near, Strategy.APPROXIMATE if enough else Strategy.APPROXIMATE_THEN_EXACT
        near = knn.knn(allowed if allowed is not None else entries, vector, p.depth)
        rows = [(0, r.entry_id, r.dist, i + 1) for i, r in enumerate(near.collect())]
        return self.spark.createDataFrame(rows, "query_id long, entry_id long, dist double, rank int"), strategy

    # --- reporting ----------------------------------------------------------

    def stats(self) -> DataFrame:
        entries, meta = self.storage.load()
        seen = entries.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("author").alias("authors"), F.min("date").alias("oldest"), F.max("date").alias("newest"))
        known = {"model": meta.model_version, "last_commit": meta.last_commit, "created_at": meta.created_at, "updated_at": meta.updated_at, "include_diffs": meta.include_diffs, "size": self.storage.size()}
        return seen.select("*", *(F.lit(v).alias(k) for k, v in known.items()))
