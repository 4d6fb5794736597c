import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.errors import InvalidDateFormat, sanitize
from lodestone.operators import bm25, fusion, hnsw, knn, merge, mmr
from lodestone.operators.filters import SearchFilters
from lodestone.plans import planner
from lodestone.plans.planner import Mode

DOCS = [
    (0, "Files: src/auth.rs\nfix token refresh"), (1, "Files: README.md\nupdate docs"), (2, "Files: Cargo.toml\nbump clap to 4.5"),
    (3, "Files: src/auth.rs\nfix: patch CVE-2024-1234 in token refresh"), (4, "Files: src/ui.rs\nadd dark mode"), (5, "Files: src/db.rs\nfix query planner"),
]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.Bm25Index.build(spark.createDataFrame(DOCS, "entry_id long, text string"))


def ids(df):
    return [r.entry_id for r in df.orderBy("rank").collect()]


def test_bm25(spark, index):
    find = lambda q, k=10, allowed=None: ids(index.search(bm25.one_query(spark, q), k, allowed))
    assert find("CVE-2024-1234")[0] == 3 and find("clap") == [2] and sorted(find("src/auth.rs"))[:2] == [0, 3]
    assert find("kubernetes helm chart") == [] and find("") == [] and find("fix", 0) == []
    assert find("fix fix fix") == find("fix")
    some = spark.createDataFrame([(5,)], "entry_id long")
    assert find("fix", allowed=some) == [5]
    full = {r.entry_id: r.score for r in index.search(bm25.one_query(spark, "fix"), 10).collect()}
    assert index.search(bm25.one_query(spark, "fix"), 10, some).first().score == pytest.approx(full[5])
    assert index.add(spark.createDataFrame([(6, "clap again")], "entry_id long, text string")).stats.first().n == 7


def test_bm25_empty(spark):
    empty = bm25.Bm25Index.build(spark.createDataFrame([], "entry_id long, text string"))
    assert tuple(empty.stats.first()) == (0, 0, 0.0) and empty.search(bm25.one_query(spark, "x"), 5).count() == 0


def test_idf_is_positive(spark, index):
    assert bm25.document_frequency(index.postings, index.stats).where("idf <= 0").count() == 0


def test_filters(spark):
    rows = spark.createDataFrame(
        [(1, "Alice Chen", "2024-06-15 12:00:00", "Files: src/a.rs\n+x"), (2, "Bob", "2024-06-15 23:59:59", "Files: b.md\n+src/"), (3, "renovate[bot]", "2024-06-16 00:00:00", "+modified src/a.rs")],
        "entry_id long, author string, date string, diff_summary string",
    ).withColumn("date", F.col("date").cast("timestamp"))
    got = lambda **kw: sorted(r.entry_id for r in SearchFilters(**kw).apply(rows).collect())
    assert got() == [1, 2, 3] and not SearchFilters().is_active()
    assert got(author="alice") == [1] and got(author="[BOT]") == [3] and got(author="%") == []
    assert got(after="2024-06-16") == [3] and got(before="2024-06-15") == [1, 2] and got(after="2024-06-15", before="2024-06-15") == [1, 2]
    assert got(file="src/") == [1, 3] and got(author="b", file="src/") == [3]
    for bad in ("not-a-date", "2024-13-45"):
        with pytest.raises(InvalidDateFormat) as e:
            SearchFilters(after=bad).predicate()
        assert e.value.code == "E4001"


def _rank(spark, lists):
    return [spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(r)], "query_id long, entry_id long, rank int") for r in lists]


@pytest.mark.parametrize(
    ("lists", "k", "want"),
    [
        ([[7, 3, 9]], 3, [7, 3, 9]), ([[1, 5, 2], [9, 5, 8]], 1, [5]), ([[1, 2], [2, 1]], 2, [1, 2]), ([[1, 1, 2]], 2, [1, 2]), ([[1, 2], [2, 3], [2, 1]], 1, [2]), ([[1], [1]], 0, []),
    ],
)
def test_rrf(spark, lists, k, want):
    assert ids(fusion.rrf(_rank(spark, lists), k)) == want


def test_rrf_lifts_what_both_have(spark):
    got = ids(fusion.rrf(_rank(spark, [list(range(200)), [199, 5]]), 5))
    assert got[0] == 5 and 199 in got


def test_mmr():
    x = np.array([[1, 0], [1, 0], [1, 0], [0, 1.0]])
    rel = np.array([0.9, 0.89, 0.88, 0.5])
    assert mmr.choose(rel, x, 2) == [0, 3] and mmr.choose(rel, x, 3, 1.0) == [0, 1, 2]
    assert mmr.choose(rel, x, 10)[0] == 0 and len(mmr.choose(rel, x, 10)) == 4 and mmr.choose(rel, x, 0) == []
    assert mmr.choose(rel, x, 2, 7.0) == mmr.choose(rel, x, 2, 1.0)


def test_mmr_clamps(spark):
    rows = spark.createDataFrame([(float("nan"),), (2.0,), (-1.0,), (None,), (0.25,)], "r double")
    assert [r.x for r in rows.select(mmr.clamp_relevance(F.col("r")).alias("x")).collect()] == [0.5, 1.0, 0.0, 0.5, 0.25]


def _unit(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_keep_best():
    ids_, d = np.array([5, 3, 9, 1]), np.array([0.5, 0.5, np.nan, 0.7])
    assert ids_[knn.keep_best(ids_, d, 2)].tolist() == [3, 5] and ids_[knn.keep_best(ids_, d, 9)].tolist() == [3, 5, 1, 9] and len(knn.keep_best(ids_, d, 0)) == 0


def test_knn_batch_equals_single(spark):
    x = _unit(200, 8, 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry_id long, embedding array<double>").repartition(3)
    queries = rows.where("entry_id < 5").select(F.col("entry_id").alias("query_id"), "embedding")
    batch = {(r.query_id, r["rank"]): r.entry_id for r in knn.knn_batch(rows, queries, 4).collect()}
    for q in range(5):
        assert [batch[q, i + 1] for i in range(4)] == [r.entry_id for r in knn.knn(rows, x[q].tolist(), 4).collect()]
    assert knn.knn_worst(knn.knn(rows, x[0].tolist(), 3), 5).first().worst is None


def test_hnsw_recall_filter_and_shape():
    x = _unit(2000, 32, 2)
    g = hnsw.Graph(np.arange(len(x)), x)
    hits = 0
    for q in _unit(50, 32, 3):
        truth = set(np.argsort(-(x @ q))[:10].tolist())
        hits += len(truth & set(g.search(q, 10, 128)[0].tolist()))
    assert hits / 500 >= 0.95
    allow = np.arange(len(x)) % 3 == 0
    found, dist = g.search(x[1], 10, allow=allow)
    assert len(found) == 10 and all(i % 3 == 0 for i in found) and list(dist) == sorted(dist)
    assert all(len(layer) <= g.params.degree(i) and n not in layer for n, node in enumerate(g.links) for i, layer in enumerate(node))
    again = hnsw.Graph.load(g.dump())
    assert again.search(x[5], 7)[0].tolist() == g.search(x[5], 7)[0].tolist() and again.links == g.links
    assert len(hnsw.Graph(np.zeros(0, int), np.zeros((0, 4))).search(np.ones(4), 3)[0]) == 0


def test_hnsw_shards(spark):
    x = _unit(600, 16, 4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry_id long, embedding array<double>")
    graphs = hnsw.build_graphs(rows, 3)
    queries = spark.createDataFrame([(0, x[7].tolist())], "query_id long, embedding array<double>")
    assert ids(hnsw.search_graphs(graphs, queries, 5, 100, shards=3))[0] == 7
    allowed = rows.where("entry_id % 2 = 0")
    assert all(i % 2 == 0 for i in ids(hnsw.search_graphs(graphs, queries, 5, 100, allowed, 3)))


def test_hnsw_more_queries_go_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_unit(60, 8, 5))], "entry_id long, embedding array<double>")
    graphs = hnsw.build_graphs(rows, 1).localCheckpoint()
    queries = rows.where("entry_id < 11").select(F.col("entry_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, hnsw.search_graphs(graphs, queries, 3).collect()))
    monkeypatch.setattr(hnsw, "MOST_QUERIES", 8)
    assert len(whole) == 33 and sorted(map(tuple, hnsw.search_graphs(graphs, queries, 3).collect())) == whole


def test_planner():
    p = lambda **kw: planner.plan(**({"k": 10, "mode": "hybrid", "diverse": False, "exact": False, "candidates": 5000, "graph_usable": True, "words_usable": True} | kw))
    assert p().use_graph and p().depth == 50 and p(k=20).depth == 80
    assert not p(exact=True).use_graph and not p(candidates=2048).use_graph and not p(graph_usable=False).use_graph
    assert p(mode="semantic").depth == 10 and p(mode="semantic", diverse=True).depth == 50
    assert p(words_usable=False).mode is Mode.SEMANTIC and p(mode="lexical", words_usable=False).mode is Mode.SEMANTIC
    assert planner.graph_usable(5, 8, 5, 8) and not planner.graph_usable(4, 8, 5, 8) and not planner.graph_usable(5, 8, 5, 9)


def test_merge(spark):
    old = spark.createDataFrame([(0, "a"), (1, "b")], "entry_id long, hash string")
    new = spark.createDataFrame([(0, "d"), (1, "b"), (2, "c"), (3, "d")], "walk_pos long, hash string")
    assert sorted(map(tuple, merge.merge_new(old, new).collect())) == [(0, "a"), (1, "b"), (2, "d"), (3, "c")]
    assert sorted(map(tuple, merge.merge_new(old.limit(0), new).collect())) == [(0, "d"), (1, "b"), (2, "c")]


def test_sanitize():
    assert sanitize(r"C:\Users\me\x and https://h/p?token=1") == r"~\x and https://h/p"


def test_numbering_is_spread(spark):
    rows = spark.range(5000).select(F.col("id").alias("walk_pos"), F.md5(F.col("id").cast("string")).alias("hash")).repartition(3)
    for name, value in (off := {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}).items():
        spark.conf.set(name, value)
    try:
        got = merge.numbered(rows, "walk_pos").select("entry_id", "walk_pos", F.spark_partition_id().alias("part")).collect()
    finally:
        for name in off:
            spark.conf.unset(name)
    assert all(r.entry_id == r.walk_pos for r in got) and len(got) == 5000 and len({r.part for r in got}) > 1


def test_hnsw_full_shard_is_quick_and_repeated_rows_are_found():
    import time

    began = time.process_time()
    x = np.concatenate([_unit(3900, 64, 6), np.repeat(_unit(4, 64, 7), 49, axis=0)])
    g = hnsw.Graph(np.arange(len(x)), x)
    assert time.process_time() - began < 20
    queries, truth = x[::40], np.sort(-(x[::40] @ x.T), axis=1)[:, 9]
    place, found, _ = g.search_many(queries, 10)
    assert np.bincount(place).tolist() == [10] * len(queries)
    near = np.einsum("ij,ij->i", x[found], queries[place]) >= -truth[place] - 1e-6
    assert near.mean() >= 0.95
    one = [set(g.search(q, 10)[0].tolist()) for q in queries[:50]]
    assert sum(len(one[i] & set(found[place == i].tolist())) for i in range(50)) >= 0.95 * 500


def test_bm25_lengths_come_from_stored_postings(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "entry_id long, text string")
    stored = spark.createDataFrame([r for r in bm25.Bm25Index.build(docs).postings.collect()])
    lengths = bm25.lengths_of(stored, docs)
    assert sorted(map(tuple, lengths.collect())) == [(1, 3), (2, 0), (3, 0)]
    assert "split(" not in lengths._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_embedder_counts_tokens(spark):
    import hashlib

    from lodestone.embed import HashedEmbedder

    texts = [(1, "b a b parseHTTPRequest2"), (2, None), (3, "x y"), (4, "ab cd ab")]
    got = {r.id: r.embedding for r in HashedEmbedder(16).embed(spark.createDataFrame(texts, "id long, t string").coalesce(1), "t").collect()}
    for i, tokens in ((1, ["parsehttprequest2", "parse", "http", "request"]), (2, []), (3, []), (4, ["ab", "cd", "ab"])):
        want = np.zeros(16)
        for t in tokens:
            h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            want[(h >> 1) % 16] += 1 if h & 1 else -1
        assert got[i] == pytest.approx((want / (np.linalg.norm(want) or 1)).tolist(), abs=1e-6)


def test_knn_batch_blocks_keep_ties_and_little(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(8)
    queries, rows = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (60, 3)).astype(float)
    rows[5] = np.nan
    ids_ = rng.permutation(60)
    for waiting in (1, 10, 1000):
        monkeypatch.setattr(knn, "WAITING", waiting)
        best = knn.Best(9, 4)
        for a in range(0, 60, 7):
            for q in range(0, 9, 2):
                best.add(q, queries[q : q + 2] @ rows[a : a + 7].T, ids_[a : a + 7])
        got = [x for part in best.kept() for x in zip(*(c.tolist() for c in part))]
        dist = np.round(1.0 - queries @ rows.T, 6) + 0.0
        assert got == [(q, int(ids_[i]), float(dist[q, i])) for q in range(9) for i in knn.keep_best(ids_, dist[q], 4)]
    monkeypatch.undo()
    tracemalloc.start()
    best, q, x = knn.Best(4000, 10), _unit(4000, 16, 9), _unit(8192, 16, 10)
    for a in range(0, len(x), knn.BLOCK_ROWS):
        for b in range(0, len(q), knn.BLOCK_QUERIES):
            best.add(b, q[b : b + knn.BLOCK_QUERIES] @ x[a : a + knn.BLOCK_ROWS].T, np.arange(a, a + knn.BLOCK_ROWS))
    assert sum(len(part[0]) for part in best.kept()) == 40000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all products at once are 262 MB


def test_bm25_work_goes_by_entry_in_parts_that_stay_small(spark, monkeypatch):
    monkeypatch.setattr(bm25, "PART_ROWS", 5)
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 3} alpha") for i in range(60)], "entry_id long, text string")
    parts = bm25.term_frequencies(docs).select("entry_id", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(parts) == 60 and len({r.part for r in parts}) > 4
    index, query = bm25.Bm25Index.build(docs), bm25.one_query(spark, "alpha w3")
    some = spark.range(20, 40).withColumnRenamed("id", "entry_id")
    whole = {r.entry_id: r.score for r in index.scores(query).collect()}
    found = index.scores(query, some)
    # A filter on one side of the exchange would have the texts tokenized once more.
    assert "isnotnull(entry_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.entry_id: r.score for r in found.collect()} == pytest.approx({i: whole[i] for i in range(20, 40)})


def test_bm25_statistics_count_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (4, "alpha")], "entry_id long, text string")
    index = bm25.Bm25Index.build(docs)
    assert tuple(index.stats.first()) == (4, 3, 0.75)
    stored = bm25.Bm25Index(index.postings, bm25.lengths_of(index.postings, docs))
    query = bm25.one_query(spark, "alpha")
    assert {r.entry_id: r.score for r in index.scores(query).collect()} == pytest.approx({r.entry_id: r.score for r in stored.scores(query).collect()})
