"""Repeated substrings from merged Burrows-Wheeler transforms.

Each shard of texts is transformed by itself. Shards are merged by refining their
interleave: a first guess puts one shard's suffixes before the other's, and every
round sorts the interleave, stably, by the symbols of the transforms, after which
it is right for prefixes one byte longer. Where neighbours part company in round
h, their longest common prefix has h bytes, so common prefixes and the intervals
of repeats come out of the merge, and no suffix is sorted again.

A round passes over all symbols, and length rounds are needed for repeats of that
length, in one process. ``repeats`` gives the same results from anchors, in few
passes and distributed; the README has the figures. This module is the method for
texts that fit a worker, and the check on the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """Transform of some texts, each closed by a terminator of its own, in the
    order of texts. ``symbols`` are bytes + 1, and 0 for what precedes a text."""

    symbols: np.ndarray
    places: np.ndarray  # of each suffix in the shard's bytes, terminators counted
    texts: int

    @staticmethod
    def build(texts: list[bytes]) -> Shard:
        data = np.concatenate([np.frombuffer(t + b"\0", np.uint8).astype(np.int64) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64) - 1
        key = data + len(texts)
        key[ends] = np.arange(len(texts))  # terminators: distinct, and before all bytes
        rank = np.unique(key, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")
        step = 1
        while len(data) and rank.max() < len(data) - 1:
            next_ = np.full(len(data), -1)
            next_[:-step] = rank[step:]
            order = np.lexsort((next_, rank))
            new = np.r_[False, (rank[order[1:]] != rank[order[:-1]]) | (next_[order[1:]] != next_[order[:-1]])]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(new)
            step *= 2
        symbols = np.where(np.isin(order, np.r_[0, ends[:-1] + 1]), 0, data[order - 1]).astype(np.uint16) if len(data) else np.zeros(0, np.uint16)
        return Shard(symbols, order, len(texts))


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (shard of each suffix in merged order), and for each merged
    place the common prefix with the one before it, -1 where it is ``rounds`` or
    more."""
    sizes = [len(s.symbols) for s in shards]
    n, ends = sum(sizes), sum(s.texts for s in shards)
    interleave = np.repeat(np.arange(len(shards)), sizes)
    first = np.repeat(np.arange(len(shards)), [s.texts for s in shards])
    symbols = np.concatenate([s.symbols for s in shards]) if shards else np.zeros(0, np.uint16)
    common = np.full(n, -1)
    common[:1] = 0
    for h in range(rounds):
        # The k-th suffix of a shard in the interleave has the shard's k-th symbol.
        here = np.empty(n, np.uint16)
        here[np.argsort(interleave, kind="stable")] = symbols
        order = np.argsort(here, kind="stable")
        block = np.cumsum(common >= 0)
        apart = np.r_[True, (here[order[1:]] != here[order[:-1]]) | (block[order[1:]] != block[order[:-1]])] if n else np.zeros(0, bool)
        apart[:ends] = True
        after = interleave[order]
        after[:ends] = first
        new = apart & (common < 0)
        common[new] = h
        if not new.any() and np.array_equal(after, interleave):
            break
        interleave = after
    return interleave, common


def repeated_windows(shards: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """Per shard and text, which windows of ``length`` bytes start there that
    also start anywhere else."""
    built = [Shard.build(texts) for texts in shards]
    interleave, common = merge(built, length)
    interval = np.cumsum(common >= 0)
    repeated = np.bincount(interval)[interval] > 1 if len(interval) else np.zeros(0, bool)
    out = []
    for i, (shard, texts) in enumerate(zip(built, shards)):
        flags = np.zeros(len(shard.places), bool)
        flags[shard.places] = repeated[interleave == i]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        out.append([flags[a : a + max(0, len(t) - length + 1)] for a, t in zip(starts, texts)])
    return out
