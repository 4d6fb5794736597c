"""Sequence packing by minimum bin slack.

Documents become token ids; whole windows are cut off and what remains of each
document is one piece. Only the histogram of piece lengths (at most one count
for each length up to the window) reaches the driver. There a bitset subset-sum
dynamic programme finds, for the longest piece left, the multiset of lengths
that fills the window closest to capacity, backtracks its counts, and uses that
pattern as often as the counts allow. Pieces then find their place from their
rank among pieces of equal length.

Defined results: a null or empty text is the end id alone; rows with equal or
null doc_id are separate documents; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound_arrow, staged, trim_memory

WINDOW = 2048
END_ID = 1
#: Characters from which on a text is encoded in parts, as a list of ids is large.
PART_CHARS = 1 << 20


class ByteBpe:
    """Token ids of the byte-level vocabulary, equal to those of the
    ``tokenizers`` file of the same name (a test compares them). Texts are encoded
    as they are: looking words up in a cache takes longer, as many occur but once.

    A lone space between two other characters always begins a token of this
    vocabulary's splitting pattern, so a long text may be cut there.
    """

    def __init__(self, json_path: str):
        import json
        import re

        import public_tokenizers
        import tiktoken

        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path) as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.json_path, self.exact = json_path, None
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lone = re.compile(r"(?<=\S) (?=\S)").search

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.json_path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(np.array(self.encode(part), dtype="<u4").tobytes() for part in self.parts(text))

    def parts(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PART_CHARS and (cut := self.lone(text, start + PART_CHARS)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]


def pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and the piece's rank among
    those of equal length within its partition ``part``; with_ids adds the ids
    as little-endian unsigned 32-bit binary."""
    bound_arrow(documents.sparkSession)
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            source = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    cut = ids[4 * start : 4 * (start + window)]
                    length = len(cut) // 4
                    source.append(row)
                    for c, v in zip(cols, (start, length, zlib.crc32(cut), n, part, seen[length], cut)):
                        c.append(v)
                    seen[length] += 1
            arrays = [batch.column(0).take(pa.array(source, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in cols[:6]] + ([pa.array(cols[6], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        del encode
        trim_memory()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, local_rank long"
    return docs.mapInArrow(run, schema + ", ids binary" * with_ids)


def _best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending) whose sum is the closest to, and
    not over, ``room``. Bit s of the set says that sum s can be reached; the
    sets before each length serve to backtrack how often it was used."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(counts[length], room // length)
        steps.append((length, most, reach))
        left, bit = most, 1
        while left > 0:  # powers of two up to the count
            take = min(bit, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            bit <<= 1
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        k = 0
        while not (before >> total) & 1:
            k += 1
            total -= length
        if k:
            used[length] = k
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, per sequence, times, first sequence, offset).
    Their number is bounded by the lengths below the window, not by the data."""
    left = {k: n for k, n in histogram.items() if n}
    used_up: Counter = Counter()
    out, sequence = [], 0
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        left[first] -= 1
        pattern = Counter(_best_fill({k: n for k, n in left.items() if n}, [k for k in lengths if left[k]], window - first)) if first < window else Counter()
        left[first] += 1
        pattern[first] += 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.append((length, used_up[length], n, times, sequence, offset))
            used_up[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return out


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset there; padded_length is the
    window, or the filled length itself where that is a power of two."""
    cut = staged(pieces(documents, tokenizer_path, window, with_ids), "pieces")
    per_part = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, window)
    filled: Counter = Counter()
    by_length: dict[int, list] = {}
    for length, rank, n, times, sequence, offset in rows:
        filled[sequence] += n * length
        by_length.setdefault(length, []).append((rank, n, sequence, offset))
    table = {k: np.array(v, dtype=np.int64).T for k, v in by_length.items()}
    full = {s: f if f & (f - 1) == 0 else window for s, f in filled.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(sorted(full), dtype=np.int64)
        padded = np.array([full[s] for s in sorted(full)], dtype=np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("local_rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                r0, n, s0, off = table[int(k)]
                i = np.searchsorted(r0, rank[at], side="right") - 1
                q = rank[at] - r0[i]
                sequence[at] = s0[i] + q // n[i]
                offset[at] = off[i] + q % n[i] * k
            pad = padded[np.searchsorted(starts, sequence, side="right") - 1] if len(starts) else sequence
            keep = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset), pa.array(pad)], names=[*kept, "sequence_id", "offset", "padded_length"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base.hint("merge"), ["part", "length"])  # base grows with the partitions
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long, padded_length long")
