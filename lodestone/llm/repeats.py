"""Removal of repeated substrings: every byte that a string of ``length`` bytes
covers which also starts anywhere else, in the same text or another.

Every window of ``length`` bytes is represented by the smallest hash among the
short strings inside it (its anchor), so that equal windows have equal anchors
at equal places; consecutive windows with one anchor form a run. The first
exchange (see ``blocks``) sends a run's anchor and a hash of all its bytes. A
run whose bytes occur twice is repeated as a whole; one whose anchor occurs once
is not repeated at all. Only the windows of runs in between, at the edges of
repeats, are sent by themselves, with one representative of each repeated run
that they might equal, and counted in the second exchange. Nothing is bounded by
the number of copies: equal keys of a block are sent once, with their count.

Equality is that of 64-bit hashes of the windows' bytes.

Defined results: a null text is empty; repeated rows are separate documents, and
so repeats of each other; an empty table gives no rows; a character of which
bytes were removed is dropped from the text that is kept, and only there (spans,
counts and digests are those of the bytes). Columns named like the results are
replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.blocks import BASE, U64, Rolling, ask, chunks_of, finish, merge, mix, pack_arrays, text_bytes, unpack_arrays, write_blocks

LENGTH = 200
BLOCK_BYTES = 1 << 20  # of text; the hashes of its windows take some 80 times that
ANCHOR = 32  # bytes; a power of two
_PLACE_BITS = 23
_SEGMENT = 1 << 22
ONCE, REPEATED, EDGE, SHOWN = 0, 1, 2, 3


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each run."""
    found = [_segment_runs(data, starts, ends, length, anchor, at) for at in range(0, max(1, len(data)), _SEGMENT)]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _segment_runs(data, starts, ends, length, anchor, at):
    none = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.maximum(starts, at)
    n = np.maximum(np.minimum(ends - length + 1, at + _SEGMENT) - first, 0)
    if not n.sum():
        return none
    part = data[at : at + _SEGMENT + length]
    h, base = part.astype(U64) + U64(1), BASE
    step = 1
    while step < anchor:
        h = h[:-step] * U64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    h = mix(h)
    best = (h >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | np.arange(len(h), dtype=U64)
    width, step = length - anchor + 1, 1
    while 2 * step <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    before = np.cumsum(n) - n
    window = np.repeat(first - before, n) + np.arange(n.sum())
    place = (best[window - at] & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.diff(place, prepend=-1) != 0
    new[before[n > 0]] = True
    new = np.flatnonzero(new)
    # Smallest hashes are small numbers: mixed again, they spread over all buckets.
    return mix(h[place[new]] ^ U64(0xD1B54A32D192ED03)), window[new], window[np.append(new[1:], len(window)) - 1]


class _Block:
    """A block's runs, and its distinct (anchor, bytes) pairs in order."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.data, self.starts, self.ends = text_bytes(table.column("text"))
        self.anchor, self.first, self.last = runs(self.data, self.starts, self.ends, length)
        self.hash = Rolling(self.data)
        whole = self.hash(self.first, self.last + length)
        order = np.lexsort((whole, self.anchor))
        a, w = self.anchor[order], whole[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(order) else order
        self.pair = np.empty(len(order), dtype=np.int64)  # of each run
        self.pair[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        self.keys, self.bytes, self.counts = a[new], w[new], np.diff(np.append(new, len(order)))
        self.one = order[new]  # a run of each pair

    def windows(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of the runs, and their hashes."""
        n = self.last[run] - self.first[run] + 1
        start = np.repeat(self.first[run] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return start, self.hash(start, start + self.length)


def _classify(blobs: list[bytes]) -> list[bytes]:
    parts = [unpack_arrays(b, "<u8", "<i8") for b in blobs]
    anchor, whole, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((whole, anchor))  # stable: the first block's pair leads
    a, w = anchor[order], whole[order]
    new_anchor = np.r_[True, a[1:] != a[:-1]]
    new_pair = new_anchor | np.r_[True, w[1:] != w[:-1]]
    pair, group = np.cumsum(new_pair) - 1, np.cumsum(new_anchor) - 1
    times = np.bincount(pair, weights=count[order])[pair]
    kinds = np.bincount(group[new_pair])[group]
    edge = (times < 2) & (kinds > 1)
    near_edge = np.bincount(group, weights=edge)[group] > 0
    state = np.where(times > 1, np.where(new_pair & near_edge, SHOWN, REPEATED), np.where(edge, EDGE, ONCE)).astype("u1")
    out = np.empty(len(order), dtype="u1")
    out[order] = state
    cuts = np.cumsum([0] + [len(p[0]) for p in parts])
    return [pack_arrays(np.zeros(0, U64), out[cuts[i] : cuts[i + 1]]) for i in range(len(parts))]


def _count(blobs: list[bytes]) -> list[bytes]:
    parts = [unpack_arrays(b, "<u1") for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    _, at = np.unique(keys, return_inverse=True)
    twice = np.bincount(at, weights=np.concatenate([p[1] for p in parts])) > 1
    cuts = np.cumsum([0] + [len(p[0]) for p in parts])
    return [pack_arrays(np.zeros(0, U64), twice[at[cuts[i] : cuts[i + 1]]].astype("u1")) for i in range(len(parts))]


def _flags(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, "u1"), *(unpack_arrays(b, "<u1")[1] for b in blobs)])


def removed_mask(block: _Block, state: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """True for each byte that a repeated window covers."""
    kind = state[block.pair]
    whole = np.flatnonzero((kind == REPEATED) | (kind == SHOWN))
    start, hashes = block.windows(np.flatnonzero(kind == EDGE))
    # The keys were those of the edges and of the shown runs together.
    shown = block.one[state == SHOWN]
    keys = np.unique(np.concatenate([hashes, block.windows(shown)[1]]))
    start = start[twice[np.searchsorted(keys, hashes)] > 0]
    cover = np.zeros(len(block.data) + 1, dtype=np.int32)
    np.add.at(cover, np.concatenate([block.first[whole], start]), 1)
    np.add.at(cover, np.concatenate([block.last[whole], start]) + block.length, -1)
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents' columns with text reduced to what is kept, and n_bytes,
    n_removed, n_spans and kept_sha256."""
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = documents.drop(*results)
    names = write_blocks(rows, block_bytes=BLOCK_BYTES)
    blocks = names.count()
    buckets = max(1, -(-blocks // 16))  # a run has 85 bytes on average, its keys 24

    def pairs(table: pa.Table):
        b = _Block(table, length)
        return b.keys, [b.bytes, b.counts.astype("<i8")]

    def edges(table: pa.Table, blobs: list[bytes]):
        b = _Block(table, length)
        state = _flags(blobs)
        own = b.windows(np.flatnonzero(state[b.pair] == EDGE))[1]
        shown = b.windows(b.one[state == SHOWN])[1]
        keys, at = np.unique(np.concatenate([own, shown]), return_inverse=True)
        n = np.bincount(at[: len(own)], minlength=len(keys)) + 2 * np.bincount(at[len(own) :], minlength=len(keys))
        return keys, [np.minimum(n, 2).astype("u1")]

    chunks = chunks_of(blocks)
    states = merge(ask(names, pairs, buckets, chunks=chunks), _classify, "repeat-runs", buckets, names, chunks)
    counts = merge(ask(names, edges, buckets, states, blocks, chunks), _count, "repeat-windows", buckets, names, chunks)

    def last(table: pa.Table, state: list[bytes], twice: list[bytes]) -> pa.Table:
        b = _Block(table, length)
        gone = removed_mask(b, _flags(state), _flags(twice))
        texts, n_removed, n_spans, sha = [], [], [], []
        for s, e in zip(b.starts.tolist(), b.ends.tolist()):
            g, d = gone[s:e], b.data[s:e]
            n = int(np.count_nonzero(g))
            kept = d[~g].tobytes() if n else d.tobytes()
            n_removed.append(n)
            n_spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(bool(len(g)) and bool(g[0])) if n else 0)
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode(errors="ignore") if n else kept.decode())
        out = {c: (pa.array(texts, pa.string()) if c == "text" else table.column(c)) for c in table.column_names}
        return pa.table(out | {"n_bytes": pa.array(b.ends - b.starts), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return finish(names, [states, counts], last, fields + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string", blocks)
