import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone import cli
from lodestone.embed import EmbeddingConfig, HashedEmbedder, OnnxEmbedder
from lodestone.errors import CommitNotFound, IndexNotFound, ModelNotFound, NoHead, NotARepository
from lodestone.operators.filters import SearchFilters
from lodestone.output import json_document, text_lines
from lodestone.plans.engine import Engine, SearchRequest
from lodestone.plans.planner import Mode, Strategy
from lodestone.sources import git
from lodestone.streaming.ingest import stream_into


def sh(path, *args, **env):
    subprocess.run(["git", "-c", "user.name=Test Author", "-c", "user.email=t@e", "-C", str(path), *args], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(path), **env})


def commit(path, name, text, message, when):
    (path / name).parent.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)
    sh(path, "add", "-A")
    date = f"2024-01-{when:02d}T12:00:00Z"
    sh(path, "commit", "-q", "-m", message, GIT_AUTHOR_DATE=date, GIT_COMMITTER_DATE=date)


@pytest.fixture
def repo(tmp_path):
    sh(tmp_path, "init", "-q", "-b", "main")
    commit(tmp_path, "src/auth.rs", "fn login() {}\n", "Add login", 1)
    commit(tmp_path, "Cargo.toml", "[package]\n", "Bump clap", 2)
    commit(tmp_path, "src/index/mod.rs", "-- x\n++ y\n", "Index module\n\nBody", 3)
    return tmp_path


def test_history(spark, repo):
    rows = git.history(spark, str(repo)).orderBy("walk_pos").collect()
    assert [r.message.strip().split("\n")[0] for r in rows] == ["Index module", "Bump clap", "Add login"]
    assert [r.walk_pos for r in rows] == [0, 1, 2] and all(r.author == "Test Author" and len(r.hash) == 40 for r in rows)
    assert rows[0].diff_summary == "Files: src/index/mod.rs\n+-- x\n+++ y\n" and str(rows[2].date) == "2024-01-01 12:00:00"
    assert all(r.diff_summary == "" for r in git.history(spark, str(repo / "src"), False).collect())


def test_history_with_merge_rename_and_long_diff(spark, repo):
    sh(repo, "checkout", "-q", "-b", "side", "HEAD~1")
    commit(repo, "side.txt", "s\n", "Side", 4)
    sh(repo, "checkout", "-q", "main")
    sh(repo, "merge", "-q", "--no-ff", "side", "-m", "Merge", GIT_AUTHOR_DATE="2024-01-05T12:00:00Z", GIT_COMMITTER_DATE="2024-01-05T12:00:00Z")
    sh(repo, "mv", "side.txt", "moved.txt")
    commit(repo, "big.txt", "é line\n" * 5000, "Big", 6)
    sh(repo, "commit", "-q", "--allow-empty", "-m", "Nothing", GIT_AUTHOR_DATE="2024-01-07T12:00:00Z", GIT_COMMITTER_DATE="2024-01-07T12:00:00Z")
    rows = {r.message.strip().split("\n")[0]: r for r in git.history(spark, str(repo)).collect()}
    assert len(rows) == 7 and rows["Nothing"].diff_summary == "Files: \n" and rows["Merge"].diff_summary.startswith("Files: side.txt\n")
    assert rows["Big"].diff_summary.startswith("Files: big.txt, moved.txt, side.txt\n") and rows["Big"].diff_summary.endswith("... (truncated)")
    assert len(rows["Big"].diff_summary.encode()) <= 10_000 + 3 + len("\n... (truncated)")


def test_source_errors(spark, tmp_path):
    with pytest.raises(NotARepository):
        git.open_repository(str(tmp_path))
    sh(tmp_path, "init", "-q")
    with pytest.raises(NoHead):
        git.walk(str(tmp_path))


def test_files_line_and_cut():
    assert git.files_line(["b", "a", "b"]) == "Files: a, b" and git.files_line(["x" * 3000]) == "Files: , ..."
    assert git.cut("aé", 2) == "aé\n... (truncated)" and git.cut("aé", 3) == "aé" and git.cut("aé€", 2) == "aé\n... (truncated)"


def test_index_lifecycle(spark, repo, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("index")))
    with pytest.raises(IndexNotFound):
        engine.search(SearchRequest("x"))
    meta, done = engine.index_repository(str(repo), quick=True)
    assert (done, meta.total_commits, meta.include_diffs) == ("rebuilt", 3, False)
    assert engine.index_repository(str(repo), full=True)[1] == "refused"
    assert engine.index_repository(str(repo), quick=True)[1] == "current"
    first, created = meta.fingerprint, meta.created_at
    commit(repo, "src/net.rs", "fn net() {}\n", "Add network", 7)
    meta, done = engine.index_repository(str(repo), quick=True)
    assert done == "updated" and meta.total_commits == 4 and meta.fingerprint != first and meta.created_at == created
    assert [r.message.split("\n")[0].strip() for r in engine.storage.load()[0].orderBy("entry_id").collect()] == ["Index module", "Bump clap", "Add login", "Add network"]
    meta, done = engine.index_repository(str(repo), full=True, force=True)
    assert done == "rebuilt" and meta.include_diffs
    o = engine.search(SearchRequest("network", 2, SearchFilters(file="src/")))
    assert o.results.first().message.startswith("Add network") and o.candidates == 3 and o.strategy is Strategy.EXACT
    assert engine.stats().first().entries == 4
    meta.last_commit = "f" * 40
    engine.storage.save(engine.storage.load()[0], meta)
    assert engine.index_repository(str(repo), full=True)[1] == "rebuilt"
    with pytest.raises(CommitNotFound):
        git.since(git.history(spark, str(repo)), "f" * 40)


CORPUS = [
    ("fix: patch CVE-2024-1234 in token refresh", "src/auth.rs", "Alice"), ("bump clap to 4.5", "Cargo.toml", "renovate[bot]"), ("add dark mode to settings", "src/ui.rs", "Bob"),
    ("refactor the query planner", "src/plan.rs", "Bob"), ("speed up index build", "src/index.rs", "Alice"), ("document the search modes", "README.md", "Alice"),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [(i, f"{i:040x}", a, f"2024-06-{i + 1:02d} 12:00:00", m, f"Files: {f}\n+x") for i, (m, f, a) in enumerate(CORPUS * 10)]
    commits = spark.createDataFrame(rows, "walk_pos long, hash string, author string, date string, message string, diff_summary string").withColumn("date", F.to_timestamp(F.concat(F.lit("2024-06-"), F.lpad((F.col("walk_pos") % 28 + 1).cast("string"), 2, "0"), F.lit(" 12:00:00"))))
    e = Engine(spark, str(tmp_path_factory.mktemp("corpus")), exact_limit=20)
    e.build(commits)
    return e


def test_search_modes(engine):
    for mode in Mode:
        o = engine.search(SearchRequest("CVE-2024-1234", 5, mode=mode))
        assert o.mode is mode and o.results.count() == 5 and "CVE" in o.results.first().message
    lexical = engine.search(SearchRequest("clap", 3, mode=Mode.LEXICAL))
    assert lexical.strategy is Strategy.EXACT and all(r.similarity is None for r in lexical.results.collect())


def test_graph_exact_and_filters(engine):
    q = lambda **kw: engine.search(SearchRequest("query planner", 4, mode=Mode.SEMANTIC, **kw))
    assert q().strategy is Strategy.APPROXIMATE and q(exact=True).strategy is Strategy.EXACT
    assert [r.entry_id for r in q().results.collect()] == [r.entry_id for r in q(exact=True).results.collect()]
    few = q(filters=SearchFilters(author="renovate"))
    assert few.candidates == 10 and few.strategy is Strategy.EXACT and {r.author for r in few.results.collect()} == {"renovate[bot]"}
    many = q(filters=SearchFilters(author="alice"))
    assert many.strategy is Strategy.APPROXIMATE and {r.author for r in many.results.collect()} == {"Alice"}


def test_diverse_and_output(engine):
    o = engine.search(SearchRequest("dark mode", 4, diverse=True, weight=0.3))
    assert o.diversified and len({r.message for r in o.results.collect()}) > 1
    doc = json.loads(json_document(o.results, "dark mode", o.mode.value, o.strategy.value, o.candidates, True, 1.5).first().json)
    assert list(doc) == ["query", "mode", "strategy", "candidates", "diversified", "took_ms", "results"]
    assert [r["rank"] for r in doc["results"]] == [1, 2, 3, 4] and doc["results"][0]["files"] == ["src/ui.rs"] and doc["results"][0]["date"].endswith("+00:00")
    lexical = engine.search(SearchRequest("clap", 1, mode=Mode.LEXICAL))
    hit = json.loads(json_document(lexical.results, "clap", "lexical", "exact", 60, False, 1.0).first().json)["results"][0]
    assert "similarity" not in hit and "keyword match" in text_lines(lexical.results)[0]


def test_derived_tables_are_rebuilt_when_stale(engine):
    _, meta = engine.storage.load()
    build = lambda: engine.spark.range(1)
    assert engine.storage.derived("probe", meta, build)[1] and not engine.storage.derived("probe", meta, build)[1]
    meta.fingerprint = "other"
    assert engine.storage.derived("probe", meta, build)[1]
    assert engine.storage.size() > 0


def test_derived_tables_survive_damage(engine, monkeypatch, caplog):
    from pathlib import Path

    _, meta = engine.storage.load()
    build = lambda: engine.spark.range(40).repartition(2)
    folder = Path(engine.storage.where) / meta.snapshot
    files = lambda: sorted(p for p in folder.glob("harm-*/*.parquet"))
    engine.storage.derived("harm", meta, build)
    for harm in (lambda f: f.unlink(), lambda f: f.write_bytes(b"no parquet"), lambda f: f.write_bytes(f.read_bytes()[:-20] + b"x" * 20)):
        for f in files():
            harm(f)
        table, built = engine.storage.derived("harm", meta, build)
        assert built and table.count() == 40
        table, built = engine.storage.derived("harm", meta, build)
        assert not built and table.count() == 40
        for old in files():
            if old.stat().st_mtime < max(f.stat().st_mtime for f in files()) - 5:
                old.unlink()
    (folder / "harm.json").write_text("{")
    assert engine.storage.derived("harm", meta, build)[1]
    blocked = folder / "full"
    blocked.write_text("a file where a folder should be")
    table, built = engine.storage.derived("full/in", meta, build)
    assert built and table.count() == 40 and "E3006" in caplog.text


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(f"{i:040x}", "A", f"2024-01-0{i + 1} 00:00:00", f"message {i}", "") for i in range(3)]
    frame = spark.createDataFrame(rows, "hash string, author string, date string, message string, diff_summary string").withColumn("date", F.col("date").cast("timestamp"))
    frame.write.parquet(str(source))
    e = Engine(spark, str(tmp_path / "index"))
    stream = lambda: stream_into(e, spark.readStream.schema(frame.schema).parquet(str(source)), str(tmp_path / "cp")).awaitTermination()
    stream()
    frame.withColumn("hash", F.concat(F.lit("f"), F.substr("hash", F.lit(2)))).unionByName(frame).write.mode("append").parquet(str(source))
    stream()
    assert e.storage.meta().total_commits == 6


def test_embedders(spark, tmp_path):
    with pytest.raises(ModelNotFound):
        OnnxEmbedder(EmbeddingConfig(path=str(tmp_path))).validate()
    rows = spark.createDataFrame([(1, "fix token"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in HashedEmbedder(16).embed(rows, "text").collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2]) and not any(got[3])


def test_cli(capsys):
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    for shell in cli.SHELLS:
        assert cli.main(["completions", shell]) == 0
    assert "search" in capsys.readouterr().out
    assert cli.main(["search", "x", "--after", "nonsense", "--path", "/"]) == 1
    out = capsys.readouterr()
    assert out.out == "" and "error[E" in out.err
    with pytest.raises(SystemExit):
        cli.main(["index", "--quick", "--full"])


def test_entry_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and __spark_entry__.entry(spark).count() == 10


def test_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_repository_of_many_commits_has_small_trees(spark, tmp_path, monkeypatch):
    from lodestone import queries as Q

    n = 3 * Q.RUN + 5
    monkeypatch.setattr(Q, "PACK_ROWS", 20)
    rows = [(i, f"{i:032x}", f"author {i}", f"subject é {i}\nline {i}\n\n-- x") for i in range(n)]
    made = spark.createDataFrame(rows, "entry_id long, hash string, author string, message string").withColumn("date", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).withColumn("diff_summary", F.lit("")).repartition(3)
    monkeypatch.setattr(Q, "commits", lambda s, d: made)
    where = Q.repository(spark, "none")
    walked = git.history(spark, where).orderBy("walk_pos").collect()
    assert [r.author for r in walked] == [f"author {n - 1 - i}" for i in range(n)] and git.walk(where) == [r.hash for r in walked]
    for r in walked:
        i = n - 1 - r.walk_pos
        assert r.diff_summary == f"Files: docs/{i}.txt\n+subject é {i}\n+line {i}\n+\n+-- x\n" and r.message.strip() == f"subject é {i}"
        tree = subprocess.run(["git", "-C", where, "ls-tree", "-r", "--name-only", r.hash], capture_output=True, text=True, check=True).stdout.split()
        assert f"docs/{i}.txt" in tree and len(tree) <= Q.RUN + 1
    assert git.since(git.history(spark, where, False), walked[10].hash).count() == 10
