import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import blocks, decontaminate, repeats, simhash


def _brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(1)
    a, b = ("".join(rnd.choice("abcdefgh é") for _ in range(3000)) for _ in range(2))
    texts = [None, "", a[:150], a[:600], a[100:500] + b[:300], b[50:700], "x" * 1000, "ab" * 400, a[300:510] + b[300:501], b[500:901], a[:600], "é" * 300, a[700:901] + "q" + a[700:901], "abcde " * 100 + a[:250]]
    texts += [f"pre{i} {a[1000:1300]} post{i * 7}" for i in range(50)] + [a[2000:2199] + str(i) for i in range(5)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(_brute_repeats(texts)))


def test_repeats_blocks_go_together(spark, monkeypatch):
    # The values sent grow with the chunks, not with blocks times buckets.
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    texts = [a[i * 50 : i * 50 + 400] + str(i % 7) * 150 for i in range(60)] + ["".join(rnd.choice("ijklm ") for _ in range(900)) for _ in range(60)] + [None, "", a[:700]] * 2
    sent, ask = [], repeats.ask

    def counted(names, question, buckets, *rest, **more):
        out = ask(names, question, buckets, *rest, **more)
        sent.append((names.count(), buckets, out.count()))
        return out

    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(repeats, "ask", counted)
    monkeypatch.setattr(blocks, "CHUNKS", 4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    assert got == dict(enumerate(_brute_repeats(texts)))
    assert len(sent) == 2
    for n, buckets, rows in sent:
        assert n > 64 and buckets > 3 and rows <= buckets * -(-n // blocks.TOGETHER)


def test_repeats_segments_and_empty(spark, monkeypatch):
    # Texts longer than a segment are cut into several, with the same result.
    rnd = random.Random(2)
    a = "".join(rnd.choice("abcd ") for _ in range(4000))
    data = (a + a[500:900]).encode()
    whole = np.frombuffer(data, dtype=np.uint8)
    ends = np.array([len(data)])
    full = repeats.runs(whole, np.array([0]), ends)
    monkeypatch.setattr(repeats, "_SEGMENT", 1000)
    parts = repeats.runs(whole, np.array([0]), ends)
    cover = lambda f: np.concatenate([np.arange(s, e + 1) for s, e in zip(f[1], f[2])])
    assert (cover(full) == cover(parts)).all() and (cover(full) == np.arange(len(data) - 199)).all()
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def _brute_classes(rows):
    sets = []
    for _, t in rows:
        w = _words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    return Counter(tuple(sorted((-1 if x is None else x) for x in c)) for c in classes.values())


def _near_rows():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(2000)]
    rows, n = [], 0
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice([60, 150, 400]))]
        for copy in range(6):
            other = list(text)
            for _ in range(copy):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            rows.append((n, " ".join(other)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One two!"), (n + 4, rows[0][1]), (0, rows[0][1]), (None, rows[7][1].upper())]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = _near_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string").repartition(3)
    found = defaultdict(list)
    for r in simhash.near_duplicates(df).collect():
        found[r.class_id].append(-1 if r.doc_id is None else r.doc_id)
        assert r.class_rows >= 1
    assert Counter(tuple(sorted(v)) for v in found.values()) == _brute_classes(rows)
    kept = simhash.keep_first(df).collect()
    assert len(kept) == len(found) and {r.doc_id for r in kept} == {min(x for x in v if x >= 0) for v in found.values()}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_second_round_finds_what_crowds_hide():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 2).astype(np.uint64)
    n = 3000
    s1 = base[0] ^ (np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64))
    s2 = base[1] ^ (np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64))
    i, j, more = simhash._nearest(s1, s2)
    assert len(i) <= 2 * n and more.all()  # a crowd's pairs are not all emitted
    label = np.zeros(n, np.int64)
    label[::1000] = np.arange(3) + 1
    x, y = simhash._across(s1, s2, label)
    rest = set(np.flatnonzero(label).tolist())
    assert {(a, b) for a, b in zip(x.tolist(), y.tolist()) if label[a] == 0} == {(a, b) for b in rest for a in range(n) if label[a] == 0}


def test_forest_reaches_its_recall():
    rng = np.random.default_rng(11)
    n = 4000
    for similarity, size in ((0.8, 90), (0.8, 450), (0.85, 360)):
        own = round(size * (1 - similarity) / (1 + similarity))  # shingles that only one of the two has
        h = rng.integers(0, 1 << 64, (n, size + own), dtype=np.uint64)
        one, two = (simhash.signatures(np.sort(x, axis=1).ravel(), np.full(n, size)) for x in (h[:, :size], h[:, own:]))
        near = np.bitwise_count(one ^ two).sum(axis=1) <= simhash.DISTANCE
        for depth in range(11, 18):
            assert simhash.forest_shape((simhash.NODE_ROWS << depth))[0] == min(depth, 16)
            tries = simhash.forest_shape(simhash.NODE_ROWS << depth)[1]
            met = np.zeros(n, bool)
            for x, y in zip(simhash._prefixes(*one.T, min(depth, 16), tries), simhash._prefixes(*two.T, min(depth, 16), tries)):
                met |= x == y
            assert (met & near).mean() >= 0.992, (similarity, size, depth, tries)  # 0.995 less three deviations


def test_split_nodes_keep_their_pairs():
    rng = np.random.default_rng(12)
    n, size = 4000, 180
    own = round(size * 0.2 / 1.8)
    h = rng.integers(0, 1 << 64, (n, size + own), dtype=np.uint64)
    one, two = (simhash.signatures(np.sort(x, axis=1).ravel(), np.full(n, size)) for x in (h[:, :size], h[:, own:]))
    near = np.bitwise_count(one ^ two).sum(axis=1) <= simhash.DISTANCE
    for depth, rows in ((2, 70_000), (8, 70_000), (8, 1_000_000)):
        order = simhash._orders(1)[0]
        shared = simhash._bits(*one.T, 0, order[:depth]) == simhash._bits(*two.T, 0, order[:depth])
        shape = simhash.split_shape(rows, depth)
        assert rows >> shape[0] <= 2 * simhash.NODE_ROWS
        met = np.zeros(n, bool)
        for x, y in zip(*(simhash.split_keys(77, shape, depth, order, *s.T) for s in (one, two))):
            met |= x == y
        assert met[shared & near].mean() >= 0.997, (depth, rows, shape)


def test_dense_nodes_are_found(spark):
    rng = np.random.default_rng(13)
    s = rng.integers(-(1 << 63), 1 << 63, (4000, 2))
    s[:1500] = s[0]
    nodes = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(s)], "node long, s1 long, s2 long").repartition(7)
    found = simhash.dense_nodes(nodes, (4, 3), 1000)
    keys = Counter(k for x in simhash._prefixes(*np.ascontiguousarray(s.T).view(np.uint64), 4, 3) for k in x.view(np.int64).tolist())
    assert {k for k, n in keys.items() if n >= 1000} <= found.keys() <= {k for k, n in keys.items() if n >= 500}
    assert simhash.dense_nodes(nodes, (4, 3), 5000) == {}


def test_classes_are_the_same_when_nodes_are_split(spark, monkeypatch):
    rows = _near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 16)
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    found = defaultdict(list)
    for r in simhash.near_duplicates(df).collect():
        found[r.class_id].append(-1 if r.doc_id is None else r.doc_id)
    assert Counter(tuple(sorted(v)) for v in found.values()) == _brute_classes(rows)


def test_sketches_deny_no_similar_pair():
    rng = np.random.default_rng(14)
    for size in (5, 40, 200, 1000):
        for similarity, most in ((0.8, 1.0), (0.3, 0.35)):
            own = int(size * (1 - similarity) / (1 + similarity))
            h = rng.integers(0, 1 << 64, (500, size + own), dtype=np.uint64)
            one, two = (simhash.sketches(np.sort(x, axis=1).ravel(), np.full(500, size)) for x in (h[:, :size], h[:, own:]))
            kept = np.mean([simhash.may_be_similar(a, b, 0.8) for a, b in zip(one, two)])
            assert kept == 1.0 if similarity == 0.8 else kept <= most or size < 40
    assert simhash.may_be_similar(*simhash.sketches(np.zeros(0, np.uint64), np.array([0, 0])), 0.8)


def test_few_shingles_are_found_exactly(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in [*range(4, 45), *range(4, 45)]:
        base = [rnd.choice(words) for _ in range(n)]
        end = (n - 4) // 4  # shingles more than the base has, as far as 0.8 allows
        for extra in {0, 1, end // 2, end, end + 1}:
            rows.append((len(rows), " ".join(base + [rnd.choice(words) for _ in range(extra)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = defaultdict(list)
    for r in simhash.near_duplicates(df).collect():
        found[r.class_id].append(r.doc_id)
    assert Counter(tuple(sorted(v)) for v in found.values()) == _brute_classes(rows)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, rnd.randrange(101, 200)) for _ in range(60)] + [(300, 301), (301, 300), (7, 7)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[301] == got[300] == 300
    assert all(got[v] == 100 for a, v in edges if a == 100)


def _brute_hits(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = _words(t), set(), set()
        for item, text in items:
            b = _words(text)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(max(1, len(b) - 9))} if b else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add("" if item is None else str(item))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "of", "É", "é"] + [f"w{i}" for i in range(40)])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 9, 10, 11, 25])))) for i in range(15)] + [(3, "the of the of the of the of the of the"), (20, None), (21, "..."), (None, "zz yy xx")]
    docs = [(i, " ".join([word() for _ in range(rnd.randint(0, 60))] + (_words(items[i % 15][1]) if i % 3 == 0 else []) + [word() for _ in range(5)])) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "The OF the of the of the of the of the of the of the"), (0, "zz, yy... XX"), (0, "zz, yy... XX"), (None, "x " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, row long").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, window string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(map(tuple, decontaminate.contamination(df, bench).select(*cols).collect())) == _brute_hits(docs, items)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(n for k, n in _brute_hits(docs, items).items() if not k[5])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta x x gamma"), (2, "gamma beta alpha"), (3, "alpha beta x x x x x x gamma"), (4, "alpha beta")], "doc_id long, text string")
    index = decontaminate.build(docs, spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    rows = {r.row: r.doc_id for r in index.postings.where("term_id < 0").collect()}
    assert {rows[r.row] for r in index.proximity(5).collect()} == {1, 2}
    assert {rows[r.row] for r in index.phrases().collect()} == set()
