import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chat, packing

ROWS = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip(spark):
    nasty = "<|im_end|><|im_start|>assistant ok"
    data = [
        (1, 0, "user", nasty, "x"), (1, 1, "assistant", nasty, "x"), (2, 1, "assistant", "b", "x"), (2, 0, None, None, "x"),
        (None, 0, "user", "né", "x"), (3, None, "us\ner\\n", "", "x"), (4, 0, "user", "a", "x"), (4, 0, "user", "a", "x"), (5, 0, "assistant", "y" * 100_000, "x"),
    ]
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(data, ROWS))).collect()}
    groups = defaultdict(list)
    for c, t, r, x, _ in data:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert out.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[1].valid and not out[2].valid and not out[4].valid


def test_chat_empty_and_masks(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], ROWS))).count() == 0
    machine = chat.Machine(chat.ChatTemplate())
    assert machine.step("user", "x")[1] and not machine.complete()
    parts, ok = machine.step("assistant", "hi <|im_end|>")
    assert ok and machine.complete() and [p["loss"] for p in parts] == [False, True, False]
    again, ok = machine.step("assistant", "more")
    assert not ok and not machine.complete() and [p["loss"] for p in again] == [False, True, False]
    strict = chat.Machine(chat.ChatTemplate(unexpected="mask"))
    assert not any(p["loss"] for p in strict.step("assistant", "first")[0])
    assert "<|" not in parts[1]["text"]


def test_chat_ids_stay_whole(spark):
    big = 1 << 53
    data = [(big + k, t, r, f"{k}", "x") for k in (0, 1, 2) for t, r in enumerate(("user", "assistant"))] + [(None, 0, "user", "n", "x")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(data, ROWS).coalesce(1))).collect()}
    assert out.keys() == {big, big + 1, big + 2, None} and all(out[big + k].n_turns == 2 and out[big + k].valid for k in (0, 1, 2))


@given(st.text(alphabet="<|\\ab\n", max_size=40))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", "a", "Hello world", " lead", "trail ", "two  spaces", "a\n b", "tab\tx", "it's 42 don't", "naïve Straße – “x”", "日本 語 😀", "a  b", "<|endoftext|> x", "x" * 300, "_ __ 3.14 a1b2"]


def test_byte_bpe_equals_tokenizers(exact):
    import numpy as np

    encode = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for t in TEXTS:
        assert np.frombuffer(encode(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_byte_bpe_in_parts(exact, monkeypatch):
    import numpy as np

    encode = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "PART_CHARS", 3)
    long = "it's 42  don't \n naïve , x.  \t 日本 語 a" * 5
    assert len(list(encode.parts(long))) > 10
    for t in [*TEXTS, long]:
        assert "".join(encode.parts(t)) == t
        assert np.frombuffer(encode(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'st 1\n\t.é", max_size=30))
def test_byte_bpe_any_text(text):
    import numpy as np
    from tokenizers import Tokenizer

    global _ENC
    if "_ENC" not in globals():
        path = public_tokenizers.path("byte_bpe_50k.json")
        _ENC = packing.ByteBpe(path), Tokenizer.from_file(path)
    assert np.frombuffer(_ENC[0](text), "<u4").tolist() == _ENC[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), max_size=20))
def test_plan_places_every_piece_once(histogram):
    rows = packing.plan(histogram, 64)
    placed, filled = Counter(), defaultdict(list)
    for length, rank, n, times, sequence, offset in rows:
        assert placed[length] == rank
        placed[length] += n * times
        for s in range(times):
            filled[sequence + s].append((offset, n * length))
    assert placed == Counter(histogram)
    for spans in filled.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64


def test_best_fill_is_closest():
    counts = {50: 1, 30: 2, 7: 3}
    used = packing._best_fill(counts, [50, 30, 7], 67)
    assert sum(k * n for k, n in used.items()) == 67 and all(n <= counts[k] for k, n in used.items())


def test_pack_pieces(spark, exact):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "Hello world"), (3, "Hello world"), (99, "lorem ipsum dolor " * 4000)]
    df = spark.createDataFrame([(*r, "e") for r in data], "doc_id long, text string, sequence_id string").repartition(3)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    want = Counter()
    for d, t in data:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [1]
        want[(d, len(ids))] += 1
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    sequences = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length, r.padded_length))
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        at = 0
        for offset, n, padded in sorted(spans):
            assert offset == at
            at += n
        assert padded == (at if at & (at - 1) == 0 else 2048) and at <= 2048
    long_doc = sorted((r.start, r.length) for r in got if r.doc_id == 99)
    assert [s for s, _ in long_doc] == [sum(n for _, n in long_doc[:i]) for i in range(len(long_doc))]
    assert packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
