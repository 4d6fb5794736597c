from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bwt


def test_one_shard_is_the_transform():
    shard = bwt.Shard.build([b"banana"])
    assert bytes(s + 64 if s < 2 else s - 1 for s in shard.symbols.tolist()).decode() == "annb@aa"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 2 for x in b)), max_size=4), max_size=4), st.integers(1, 5))
def test_merge_equals_sorting_everything(shards, length):
    built = [bwt.Shard.build(s) for s in shards]
    interleave, common = bwt.merge(built, 64)
    suffixes, number = [], 0
    for i, texts in enumerate(shards):
        for t in texts:
            suffixes += [((*(x + 1000 for x in t[k:]), number), i) for k in range(len(t) + 1)]
            number += 1
    suffixes.sort()
    assert interleave.tolist() == [i for _, i in suffixes]
    for p in range(1, len(suffixes)):
        a, b = suffixes[p - 1][0], suffixes[p][0]
        assert common[p] == next(k for k in range(99) if a[k] != b[k])
    seen = Counter(t[k : k + length] for s in shards for t in s for k in range(len(t) - length + 1))
    want = [[[seen[t[k : k + length]] > 1 for k in range(len(t) - length + 1)] for t in s] for s in shards]
    assert [[f.tolist() for f in s] for s in bwt.repeated_windows(shards, length)] == want


def test_agrees_with_the_distributed_form(spark):
    from lodestone.llm import repeats

    rng = np.random.default_rng(0)
    base = bytes(rng.integers(97, 105, 2000).tolist())
    texts = [base[:700], base[300:1100], base[600:801] + b"zz" + base[1000:1400], base[1500:1650], b"", b"ab" * 300]
    flags = [f for s in bwt.repeated_windows([texts[:2], texts[2:4], texts[4:]], 200) for f in s]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (t, f) in enumerate(zip(texts, flags)):
        gone = np.zeros(len(t), bool)
        for k in np.flatnonzero(f):
            gone[k : k + 200] = True
        assert got[i] == gone.sum()
