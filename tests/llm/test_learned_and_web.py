import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import ann, html_text, lm, queries, toxicity, warc


def _tokens(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low)) + [None]


def _docs(n=60):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)] + ["É", "The"]
    p = np.arange(1, 33) ** -1.2
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(n)] + [(1000, None), (1001, ""), (None, "w1 new"), (3, "w1 w2"), (3, "w1 w2")]


def test_lm_counts_and_probabilities(spark):
    docs = _docs()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    got = lm.score(df).collect()
    uni = Counter(t for d, x in docs if fold(d) != 1 for t in _tokens(x))
    total, distinct = sum(uni.values()), len(uni)
    want = Counter()
    for d, x in docs:
        t = _tokens(x)
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        want[(d, fold(d) == 1, len(t), sum(uni[w] > 0 for w in t), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(df.limit(0)).count() == 0


def test_lm_is_a_distribution(monkeypatch):
    """For any context the mixed probabilities of all words and one unknown sum to 1."""
    import pyarrow as pa

    text = "a b a b a c a b b a c c a"
    block = pa.table({"text": [text], "fold": [2]})
    keys = lm.keys_of(block)
    one, two = keys[1], keys[2]
    counts = np.bincount(one, minlength=len(keys[0])) + np.bincount(two, minlength=len(keys[0]))
    bucket, bigram, unigram = lm.estimates(keys, counts, len(one), len(set(one.tolist())))
    weights = lm.learn([(1, 20, 30, 5), (2, 0, 40, 7), (2, 9, 40, 7), (3, 9, 0, 1)], 4)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and (weights[0, 0] == 0)
    following = defaultdict(dict)
    words = [*text.split(), None]
    for i in range(1, len(words)):
        following[words[i - 1]][words[i]] = bigram[i]
    assert all(abs(sum(v.values()) - 1) < 1e-9 for v in following.values())
    assert abs(sum({w: unigram[i] for i, w in enumerate(words)}.values()) - 1) < 1e-9


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    """The score of every text from counts in dictionaries and the weights learned."""
    learned, real = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: learned.append(real(*a)) or learned[-1])
    rows = _docs()
    got = Counter((r.doc_id, round(r.score, 8)) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    one, two = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            words = _tokens(t)
            one.update(words)
            two.update(zip(["<start>", *words[:-1]], words))
    n, distinct, want = sum(one.values()), len(one), Counter()
    for i, t in rows:
        words, total = _tokens(t), 0.0
        for before, word in zip(["<start>", *words[:-1]], words):
            context = one[None] if before == "<start>" else one[before]
            w = learned[0][min(math.frexp(context)[1], lm.CONTEXT_BUCKETS - 1)]
            bigram = two[before, word] / context if context else 0.0
            total += math.log10(w[0] * bigram + w[1] * one[word] / n + w[2] / (distinct + 1))
        want[i, round(total, 8)] += 1
    assert got == want


def test_learning_prefers_what_predicts():
    sharp = lm.learn([(5, 1 + 8, 1 + 80, 100)], 1000)  # bigram 1/2, unigram 2**-10
    blind = lm.learn([(5, 0, 1 + 40, 100)], 1000)
    assert sharp[5, 0] > 0.95 and blind[5, 0] < 0.05 and blind[5, 1] > 0.9


def test_toxicity_learns_and_folds(spark):
    rng = np.random.default_rng(1)
    clean = [f"c{chr(97 + i % 26)}{chr(97 + i // 26)}zz" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        text = list(rng.choice(clean, 40))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                text.insert(int(rng.integers(0, 40)), str(rng.choice(["idiot", "moron", "vequant", "vequer", "vequille"])))
        elif i % 7 == 0:
            text.insert(3, "harmless moron")  # a phrase that is none
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    odd = [(900, None), (901, ""), (902, "you 1d10t m0r0n, vequzz idіot! " * 3), (903, " ".join(clean[:50])), (None, "idiot moron idiot moron " * 5), (904, ("czz " * 50_000))]
    df = spark.createDataFrame(rows + [(*o, "x") for o in odd], "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df, lexicon).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    right = sum(got[i].predicted == t for i, t in labels)
    assert right >= 295 and got[902].predicted == 1 and got[None].predicted == 1
    assert not (got[900].predicted or got[901].predicted or got[903].predicted or got[904].predicted)
    assert got[900].score == got[901].score
    none = toxicity.score(df, toxicity.fit(df, lab.limit(0)))
    assert none.where("predicted = 1").count() == 0
    assert toxicity.score(df.limit(0), lexicon).count() == 0
    assert toxicity.fold_text("L0SER​") == toxicity.fold_text("loser") != toxicity.fold_text("poser")


def test_toxicity_fit_tasks_without_matches(spark):
    """More tasks than labelled rows, so that some see no text and some no match."""
    rows = [(i, "plain words only" if i % 2 else "vile vile slur here") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        lexicon = toxicity.fit(df, spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(80)], "doc_id long, toxic int"))
        assert {r.doc_id for r in toxicity.score(df, lexicon).where("score > 0.5").collect()} == set(range(0, 80, 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_toxicity_on_held_out_rows(spark):
    """As op9 learns: rows of two folds are fitted, those of the third judged."""
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, sf).where("held_out").select("doc_id", "score", "predicted")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic").where("toxic is not null"), "doc_id").collect()
    toxic, clean = ([r for r in rows if r.toxic == t] for t in (1, 0))
    assert len(toxic) >= 100 and len(clean) >= 1000
    assert sum(r.predicted for r in toxic) >= 0.92 * len(toxic) and sum(r.predicted for r in clean) <= 0.005 * len(clean)


def test_exception_phrases():
    lexicon = toxicity.Lexicon({" moron ": 3.0}, {" harmless moron "})
    automaton = lexicon.automaton()
    assert lexicon.matched(automaton, " a moron b ") == 3.0
    assert lexicon.matched(automaton, " harmless moron b moron ") == 3.0


PAGES = "page_id long, url string, html string, text string"


def _pages():
    data = [(i, f"http://www.h{i % 3}.example.com/p/{i}?b=2&a=1", f"<p>{i}</p>") for i in range(30)]
    data += [(100 + i, f"http://x.org/{i}", "same é") for i in range(20)] + [(200, None, None), (201, "http://x.org/e", ""), (None, "http://x.org/n", "same é"), (300, "http://x.org/rep", "rep"), (300, "http://x.org/rep", "rep"), (301, "bad\r\nurl", "z" * 300_000)]
    return data


def test_warc_round_trip(spark):
    pages = _pages()
    index = warc.archive(spark.createDataFrame([(*p, "x") for p in pages], PAGES).repartition(4))
    got = Counter(tuple(r) for r in index.read_all(spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    groups = defaultdict(list)
    for p, _, h in pages:
        groups[(h or "").encode()].append(p)
    want = Counter()
    for p, _, h in pages:
        data = (h or "").encode()
        first = max((x for x in groups[data] if x is not None), default=None)
        response = p == first
        want[(p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first)] += 1
    assert got == want
    for p, url, h in pages[:30]:
        (entry,) = index.lookup(url)
        fields, payload = index.fetch(entry)
        assert payload.decode() == h and fields["X-Page-Id"] == str(p)
    assert len(index.lookup("http://x.org/rep")) == 2 and index.lookup("http://x.org/none") == []
    empty = warc.archive(spark.createDataFrame([], PAGES))
    assert empty.read_all(spark).count() == 0 and empty.lookup("http://x.org/") == []


def test_warc_keys_sort_by_host_and_blocks(spark):
    assert warc.url_key("http://www.A.example.com:80/Q?b=2&a=1") == "com,example,a)/q?a=1&b=2"
    rows = [(f"http://h.com/{i:04d}", i) for i in range(500)]
    manifest = spark.createDataFrame([(warc.url_key(u), i, u, "response", None, "f", i, 1) for u, i in rows], "key string, page_id long, url string, record_type string, refers_to long, file string, place long, size long")
    index = warc.CaptureIndex.build(manifest, warc.new_path(spark, "cdx"), "file:///nowhere", block_lines=7)
    for u, i in rows[::17]:
        assert [e["page_id"] for e in index.lookup(u)] == [i]


def test_html_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <div id="cookieNotice">We use</div><main><article class="post"><header><h1>T &amp; x &lt;3</h1></header><p>One <i>two</i>
 three<p>Four<br>five<ul><li>a<li>b</ul><aside>no</aside><form>x</form><footer>f</footer><!-- c --></article>
 <section class="comments"><p>c</p></section></main><script>if(a<b){"</p>"}</script></body></html>"""
    assert html_text.main_text(page) == "T & x <3\nOne two three\nFour five\na\nb"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>plain &eacute; &#233; &am &amp</p><div class=ad>buy</div>") == "plain é é &am &"
    assert html_text.main_text("<p>x <b>y</p><p>" + "z " * 200_000 + "</p>").startswith("x y\nz z")
    assert html_text.main_text('<script>var a="unclosed') == ""


def test_style_tree_cuts_what_repeats(spark):
    same = '<div class="top">Welcome to our site</div>'
    data = [(i, "http://h.com/x", f"<body>{same}<div><p>Story {i} about {'abc' * i}</p></div></body>") for i in range(12)]
    data += [(60 + i, "http://copies.com/", "<article><p>one text</p></article><div>and the same end</div>") for i in range(9)]
    data += [(50, None, "<p>only</p>"), (51, "http://other.com", f"{same}<p>once</p>"), (52, "http://h.com/n", None), (52, "http://h.com/n", None)]
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame([(*d, "x") for d in data], PAGES)).collect())
    want = Counter()
    for i in range(12):
        t = f"Story {i} about {'abc' * i}".strip()
        want[(i, t, len(t))] += 1
        if i < 9:
            want[(60 + i, "one text", 8)] += 1
    want += Counter({(50, "only", 4): 1, (51, "Welcome to our site\nonce", 24): 1, (52, "", 0): 2})
    assert got == want
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_style_tree_equals_brute_force(spark):
    """Entropies of all nodes of sf0.001's pages, counted one by one."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    seen = defaultdict(lambda: (Counter(), Counter()))
    for r in pages.select(html_text.host(pages.url).alias("host"), "html").collect():
        s = html_text._Style(r.html or "")
        for node, look in s.looks.items():
            seen[r.host, node][0][look] += 1
            seen[r.host, node][1][s.says.get(node, 0)] += 1

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n, n) for c in counts.values()) if n > 1 else 1.0

    got = {(r.host, r.node): r for r in html_text.importance(pages).collect()}
    assert got.keys() == seen.keys() and len(got) > 20
    for key, (looks, says) in seen.items():
        assert got[key].pages == sum(looks.values())
        assert abs(got[key].looks - entropy(looks)) < 1e-9 and abs(got[key].says - entropy(says)) < 1e-9


def test_style_tree_cuts_what_repeats_inside_articles(spark):
    again = '<div class="k7">Read this on our app</div>'
    inner = lambda i: f"<article><h1>Title {i}</h1><p>Story <b>not</b> {i * 7}</p>{again}<p>end {i}</p></article>"
    data = [(i, "http://h.com/x", f"<body>{inner(i)}</body>") for i in range(12)]
    data += [(100 + i, "http://same.com/x", f"<body>{inner(3)}<div>{i}</div></body>") for i in range(12)]
    data += [(200 + i, "http://body.com/x", f'<article><h1>Title {i}</h1><div itemprop="articleBody"><p>shared</p></div></article>') for i in range(12)]
    data += [(300 + i, "http://few.com/x", f"<body>{inner(i)}</body>") for i in range(7)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(*d, "x") for d in data], PAGES)).collect()}
    whole = lambda i: f"Title {i}\nStory not {i * 7}\nRead this on our app\nend {i}"
    for i in range(12):
        assert got[i] == f"Title {i}\nStory not {i * 7}\nend {i}"
        assert got[100 + i] == whole(3) and got[200 + i] == f"Title {i}\nshared"
        assert i > 6 or got[300 + i] == whole(i)


def test_ann_recall_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None] * 24), (2020, [1.0, 2.0]), (None, [1.0] * 24), (2040, rows[0][1]), (2041, rows[0][1])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    monkeypatch.setattr(ann, "PART_ROWS", 150)
    monkeypatch.setattr(ann, "PART_QUERIES", 20)
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=20, cell_rows=200).collect()
    near = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        near[r.query_id].append((r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 24 and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        truth = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        found = near[q]
        assert len(found) == 20 and [f[0] for f in found] == [i for _, i in sorted((-s, i) for i, s in found)]
        assert all(abs(s - good[q] @ good[i]) < 1e-9 for i, s in found)
        hits += len({i for _, i in truth} & {i for i, _ in found})
        total += 20
    assert hits / total >= 0.9
    assert 2020 not in near and ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_meets_a_smaller_share_of_a_larger_table():
    """Of rows in clusters, the needed share falls as the table grows."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4000, 16)) * 3
    share = []
    for n in (4000, 16_000):
        x = centres[rng.integers(0, n // 8, n) % len(centres)] + rng.standard_normal((n, 16)) * 0.2
        forest = ann.Forest(x, n // 100)
        cells = forest.cells_of(x)
        sizes = np.bincount(cells.ravel(), minlength=forest.cells)
        assert sizes.sum() == 2 * n
        s = x[:60] @ x.T
        s[np.arange(60), np.arange(60)] = -np.inf
        truth = [cells[np.argsort(-r)[:5]].tolist() for r in s]
        share.append(ann.needed(forest, sizes, x[:60], truth, 0.95) / n)
    assert share[1] < share[0]


def test_ann_queries_whose_cells_hold_only_themselves(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(20, [5.0] * 8)] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.where("vec_id = 20"), k=20, cell_rows=60).collect()
    q = min(v for i, v in rows if i == 20)
    truth = sorted(((-float(np.array(v) @ q), i) for i, v in rows if i != 20))[:20]
    assert len(got) == 20 and len({r.vec_id for r in got} & {i for _, i in truth}) >= 16
