"""Language-model scores by deleted interpolation of n-gram estimates.

A bigram's, a unigram's and a uniform estimate are mixed with weights that
depend on a bucket of the context's frequency. Expectation-maximisation learns
the weights on counts held out of training: documents of one training fold are
scored against counts of the other training folds. Afterwards all training
documents count.

Counts of all distinct n-grams of all documents are gathered by exchange (see
``blocks``); nothing is pruned. For the weights only a histogram of estimates,
in steps of an eighth of a factor of two, is summed; it has bounded size.

Defined results: a null or empty text is one end token; rows with equal doc_id
fall in the same fold and are scored each; a null doc_id has the fold of the
empty string; without training documents all scores are those of the uniform
estimate over one class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import U64, Rolling, ask, finish, merge, mix, pack_arrays, text_bytes, unpack_arrays, write_blocks
from lodestone.llm.common import fold

END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
FOLDS = 5
HELD_OUT = 1  # scored only
DELETED = 0  # counted in the end, but held out while the weights are learned
CONTEXT_BUCKETS = 24
STEPS = 8  # cells of the histogram per factor of two
LOWEST = 40 * STEPS


def tokens(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of the block's documents, each closed by END; the
    hashes of what comes before each; and the row each is of."""
    data, starts, ends = text_bytes(block.column("text"))
    upper = (data >= 65) & (data <= 90)
    lower = np.where(upper, data | 32, data).astype(np.uint8)
    word = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    hashes = Rolling(lower)(first, last)
    row = np.searchsorted(ends, first, side="right")
    n = np.bincount(row, minlength=len(starts)) + 1
    total = int(n.sum())
    out = np.empty(total, dtype=U64)
    out_row = np.repeat(np.arange(len(starts)), n)
    closing = np.cumsum(n) - 1
    is_word = np.ones(total, dtype=bool)
    is_word[closing] = False
    out[is_word], out[closing] = hashes, END
    before = np.empty(total, dtype=U64)
    before[1:] = out[:-1]
    before[closing + 1 - n] = START
    return out, before, out_row


def keys_of(block: pa.Table) -> tuple:
    """Sorted distinct keys (unigrams and bigrams) and each token's place there."""
    word, before, row = tokens(block)
    one = mix(word)
    two = mix(mix(before + U64(0x632BE59BD9B4E019)) ^ (word * U64(0x9FB21C651E98DF25)))
    keys, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    return keys, at[: len(one)], at[len(one) :], word, before, row


def _counts(block: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per key: training count, count without the deleted fold, is a unigram."""
    keys, one, two, _, _, row = keys_of(block)
    folds = block.column("fold").to_numpy()[row]
    out = []
    for keep in (folds != HELD_OUT, (folds != HELD_OUT) & (folds != DELETED)):
        out.append((np.bincount(one[keep], minlength=len(keys)) + np.bincount(two[keep], minlength=len(keys))).astype("<i8"))
    unigram = np.zeros(len(keys), dtype=np.int8)
    unigram[one] = 1
    return keys, [*out, unigram]


def _sum(blobs: list[bytes]) -> list[bytes]:
    """Answer each block with the sums for its keys; the first answer of the
    bucket also bears, once, the bucket's own totals of unigrams."""
    parts = [unpack_arrays(b, "<i8", "<i8", "i1") for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    distinct, at = np.unique(keys, return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(distinct)).astype("<i8") for i in (1, 2)]
    unigram = np.zeros(len(distinct), dtype=bool)
    unigram[at] = np.concatenate([p[3] for p in parts]).astype(bool)
    totals = np.array([x for s in sums for x in (s[unigram].sum(), np.count_nonzero(s[unigram]))], dtype="<i8")
    out, start = [], 0
    for i, p in enumerate(parts):
        own = at[start : start + len(p[0])]
        start += len(p[0])
        out.append(pack_arrays(np.zeros(0, U64), sums[0][own], sums[1][own], totals if i == 0 else totals[:0]))
    return out


def _answers(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack_arrays(b, "<i8", "<i8", "<i8") for b in blobs]
    return np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _totals(counted: DataFrame) -> list[int]:
    """Training tokens and distinct ones, and both without the deleted fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                t = unpack_arrays(blob, "<i8", "<i8", "<i8")[3]
                if len(t):
                    total += t
        yield pa.RecordBatch.from_pydict({c: pa.array([int(v)], pa.int64()) for c, v in zip("abcd", total)})

    sums = counted.select("blob").mapInArrow(run, "a long, b long, c long, d long").agg(*(F.sum(c).alias(c) for c in "abcd")).first()
    return [int(v or 0) for v in sums]


def estimates(keys_at: tuple, counts: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context's frequency, bigram and unigram estimates. A word
    is the context of as many bigrams as it has unigrams; the start, of as many
    as the end has unigrams, one per document."""
    keys, one, two, word, before, _ = keys_at
    closing = np.searchsorted(keys, mix(np.array([END], dtype=U64)))[0]
    before_at = np.empty_like(one)
    before_at[1:] = one[:-1]
    before_at[before == START] = closing
    context = counts[before_at].astype(float)
    bigram = np.divide(counts[two], context, out=np.zeros(len(one)), where=context > 0)
    bucket = np.minimum(np.frexp(context)[1], CONTEXT_BUCKETS - 1)
    return bucket, bigram, counts[one] / max(total, 1)


def _cell(estimate: np.ndarray) -> np.ndarray:
    """0 for no estimate, else 1 and up for 1, 2**(-1/8), ..."""
    with np.errstate(divide="ignore"):
        steps = np.minimum(-np.log2(estimate) * STEPS, LOWEST)
    return np.where(estimate > 0, np.rint(steps) + 1, 0).astype(np.int64)


def _histogram(table: pa.Table, blobs: list[bytes], total: int, distinct: int) -> pa.Table:
    keys_at = keys_of(table)
    deleted = table.column("fold").to_numpy()[keys_at[5]] == DELETED
    bucket, bigram, unigram = (x[deleted] for x in estimates(keys_at, _answers(blobs)[1], total, distinct))
    cells, n = np.unique((bucket.astype(np.int64) << 20) | (_cell(bigram) << 10) | _cell(unigram), return_counts=True)
    return pa.table({"bucket": pa.array(cells >> 20, pa.int32()), "two": pa.array((cells >> 10) & 1023, pa.int32()), "one": pa.array(cells & 1023, pa.int32()), "n": pa.array(n, pa.int64())})


def learn(cells: list[tuple[int, int, int, int]], distinct: int, rounds: int = 100) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate for each bucket of
    contexts, by expectation-maximisation over the held-out counts."""
    weights = np.tile([0.0, 0.9, 0.1], (CONTEXT_BUCKETS, 1))
    weights[1:] = [0.3, 0.6, 0.1]
    value = lambda c: np.where(c > 0, 2.0 ** (-(c - 1) / STEPS), 0.0)
    table = np.array(cells, dtype=np.int64).reshape(-1, 4)
    # A bucket that no held-out token has, uses the weights of all together.
    for b in [-1, *range(CONTEXT_BUCKETS)]:
        own = table if b < 0 else table[table[:, 0] == b]
        if not len(own):
            continue
        f = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1.0 / (distinct + 1))], axis=1)
        n = own[:, 3].astype(float)
        w = np.array([0.0, 0.9, 0.1]) if b == 0 else np.array([0.3, 0.6, 0.1])
        for _ in range(rounds):
            share = f * w
            share /= share.sum(axis=1, keepdims=True)
            new = np.maximum((share * n[:, None]).sum(axis=0) / n.sum(), [0.0, 1e-9, 1e-6])
            new /= new.sum()
            done = np.abs(new - w).max() < 1e-7
            w = new
            if done:
                break
        if b < 0:
            weights[1:] = w
            weights[0] = np.array([0.0, w[1], w[2]]) / (w[1] + w[2])
        else:
            weights[b] = w
    return weights


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = documents.select("doc_id", "text", fold("doc_id", FOLDS).cast("int").alias("fold"))
    names = write_blocks(rows)
    blocks = names.count()
    buckets = max(1, -(-blocks // 3))  # a block's keys are about as large as its text
    counted = merge(ask(names, _counts, buckets), _sum, "ngram-counts", buckets)
    total, distinct, total_kept, distinct_kept = _totals(counted)
    cells = finish(names, [counted], lambda t, blobs: _histogram(t, blobs, total_kept, distinct_kept), "bucket int, two int, one int, n long", blocks)
    sums = cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    weights = learn([tuple(r) for r in sums], distinct_kept)

    def last(table: pa.Table, blobs: list[bytes]) -> pa.Table:
        keys_at = keys_of(table)
        one, row = keys_at[1], keys_at[5]
        counts = _answers(blobs)[0]
        bucket, bigram, unigram = estimates(keys_at, counts, total, distinct)
        w = weights[bucket]
        p = np.log10(w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] / (distinct + 1))
        base = np.log10((counts[one] + 0.5) / (total + 0.5 * (distinct + 1)))
        size = table.num_rows
        add = lambda values: np.bincount(row, weights=values, minlength=size)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": pa.array(table.column("fold").to_numpy() == HELD_OUT),
                "n_tokens": pa.array(np.bincount(row, minlength=size), pa.int64()),
                "n_known": pa.array(add(counts[one] > 0).astype(np.int64)),
                "train_tokens": pa.array([total] * size, pa.int64()),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(p)),
            }
        )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return finish(names, [counted], last, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", blocks)
