"""Blocks of rows in the shared folder, and exchanges of packed keys between them.

Operators that need corpus-wide counts of many keys would shuffle a row per key.
Instead a block of a few MB of text sends each bucket (a range of 64-bit keys)
one binary value with its distinct keys and their counts, the bucket merges what
all blocks sent, and answers each block with one value in the block's own key
order. A key, however hot, is sent at most once per block, buckets are ranges of
hashes, one for every few blocks, and no task holds more than one block or one
bucket at a time.

Where blocks send little to a bucket, they go together in chunks: a chunk sends a
bucket one value for all of its blocks and is answered with one, which is then
dealt out to the blocks. Else the values, one per block and bucket, would grow as
the square of the table, with fewer keys in each.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_arrow, new_path, open_fs, staged, trim_memory

BLOCK_BYTES = 4 << 20
#: Blocks of a chunk at most, and chunks that there are before they get larger.
TOGETHER = 16
CHUNKS = 200

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def let_go() -> None:
    """At a task's end, so that idle workers hold little while others work."""
    _powers.clear()
    trim_memory()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Hashes of any substrings of ``data`` by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(value + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def write_blocks(rows: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store the rows as blocks of about ``block_bytes`` of text (a longer text
    is a block of its own) and return their names: block string, folder string,
    bytes long, number long. ``number`` is unique and has at most 40 bits: the
    partition, and 16 bits for the block within it."""
    bound_arrow(rows.sparkSession)
    folder = new_path(rows.sparkSession, "blocks")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        held, size, number = [], 0, TaskContext.get().partitionId() << 16

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            if number >> 16 != TaskContext.get().partitionId():
                raise ValueError("more than 65536 blocks in a partition: give the rows more partitions")
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{where}/{name}", compression=None) as out, pa.ipc.new_file(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            done = pa.RecordBatch.from_pydict({"block": [name], "folder": [folder], "bytes": pa.array([size], pa.int64()), "number": pa.array([number], pa.int64())})
            held, size, number = [], 0, number + 1
            return done

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > block_bytes:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    start = i
                    yield flush()
                size += n + 1
            if start < len(lengths):
                held.append(batch.slice(start))
        if held:
            yield flush()

    return staged(rows.mapInArrow(run, "block string, folder string, bytes long, number long"), "block-names")


def read_block(folder: str, name: str) -> pa.Table:
    trim_memory()  # of the block before
    fs, where = open_fs(folder)
    with fs.open_input_file(f"{where}/{name}") as f:
        return pa.ipc.open_file(f).read_all()


def text_bytes(column: pa.ChunkedArray, gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts (null: empty) one after the other as bytes, with ``gap`` spaces
    after each, and where each begins and ends."""
    values = [("" if v is None else v).encode() if isinstance(v, str | None) else v for v in column.to_pylist()]
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    data = np.frombuffer((b" " * gap).join([*values, b""]), dtype=np.uint8)
    ends = np.cumsum(lengths + gap) - gap
    return data, ends - lengths, ends


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Keys as they are (hashes do not compress), the rest compressed."""
    first, *rest = arrays
    out = [struct.pack("<q", len(first)), first.astype("<u8").tobytes()]
    for a in rest:
        z = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())
        out += [struct.pack("<q", len(z)), z]
    return b"".join(out)


def unpack_arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    at = 8 + 8 * n
    out = [np.frombuffer(blob, "<u8", n, 8)]
    for kind in kinds:
        (size,) = struct.unpack_from("<q", blob, at)
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 8 : at + 8 + size]), kind))
        at += 8 + size
    return out


def bucket_cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the sorted keys begins, and their end."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64) if buckets > 1 else np.zeros(0, U64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def chunks_of(blocks: int) -> int:
    """Chunks for so many blocks: of three blocks each, larger ones beyond CHUNKS."""
    return max(1, -(-blocks // min(TOGETHER, max(3, blocks // CHUNKS))))


def _in_chunks(rows: DataFrame, chunks: int) -> DataFrame:
    return rows.withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)).cast("int"))


def _ask_together(names: DataFrame, question, buckets: int, answers: DataFrame | None, chunks: int) -> DataFrame:
    """``ask`` with a chunk's number in place of a block's, and sizes binary: how
    many of the keys are each block's, in the order of the blocks' numbers."""
    schema = "bucket int, number long, sizes binary, blob binary"

    def rows(left: pa.Table, right: pa.Table | None) -> pa.Table:
        found = []
        for r in left.sort_by("number").to_pylist():
            table = read_block(r["folder"], r["block"])
            found.append(question(table) if right is None else question(table, answered(right.filter(pa.compute.equal(right.column("number"), r["number"])))))
        let_go()
        if not found:
            return pa.Table.from_pylist([])
        sizes = np.array([np.diff(bucket_cuts(keys, buckets)) for keys, _ in found])
        order = np.argsort(np.concatenate([np.repeat(np.arange(buckets), n) for n in sizes]), kind="stable")
        keys, *beside = (np.concatenate(a)[order] for a in zip(*((keys, *rest) for keys, rest in found)))
        ends = np.cumsum(sizes.sum(axis=0))
        own = np.flatnonzero(sizes.sum(axis=0))
        blobs = [pack_arrays(*(a[x:y] for a in (keys, *beside))) for x, y in zip((ends - sizes.sum(axis=0))[own].tolist(), ends[own].tolist())]
        number = pa.array([left.column("chunk")[0].as_py()] * len(own), pa.int64())
        each = pa.array([sizes[:, b].astype("<i4").tobytes() for b in own.tolist()], pa.binary())
        return pa.table({"bucket": pa.array(own, pa.int32()), "number": number, "sizes": each, "blob": pa.array(blobs, pa.binary())})

    names = _in_chunks(names, chunks)
    if answers is None:
        return names.repartitionById(chunks, "chunk").groupBy("chunk").applyInArrow(lambda left: rows(left, None), schema)
    return _beside(names, _in_chunks(answers, chunks), chunks, "chunk").applyInArrow(rows, schema)


def _deal_out(merged: DataFrame, names: DataFrame, chunks: int) -> DataFrame:
    """Answers to chunks, a byte for each key, as one answer to each of the blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.Table.from_pylist([])
        right = right.sort_by("bucket")
        numbers = np.sort(left.column("number").to_numpy())
        sizes = np.frombuffer(b"".join(right.column("sizes").to_pylist()), "<i4")
        block = np.repeat(np.tile(np.arange(len(numbers)), right.num_rows), sizes)
        values = np.concatenate([unpack_arrays(b, "u1")[1] for b in right.column("blob").to_pylist()])[np.argsort(block, kind="stable")]
        parts = np.split(values, np.cumsum(np.bincount(block, minlength=len(numbers)))[:-1])
        blobs = [pack_arrays(np.zeros(0, U64), p) for p in parts]
        return pa.table({"bucket": pa.array([0] * len(numbers), pa.int32()), "number": pa.array(numbers), "blob": pa.array(blobs, pa.binary())})

    answers = merged.withColumn("chunk", F.col("number").cast("int"))
    return _beside(_in_chunks(names, chunks), answers, chunks, "chunk").applyInArrow(run, "bucket int, number long, blob binary")


def ask(names: DataFrame, question: Callable[[pa.Table], tuple[np.ndarray, list[np.ndarray]]], buckets: int, answers: DataFrame | None = None, blocks: int = 1, chunks: int = 0) -> DataFrame:
    """Rows bucket int, number long, blob binary: per block and bucket, the
    block's sorted keys and the arrays beside them. ``question`` gets the block,
    and what was answered before if ``answers`` is given (for so many blocks).
    With ``chunks``, blocks go together in so many."""
    if chunks:
        return _ask_together(names, question, buckets, answers, chunks)

    def rows(number: int, found: tuple[np.ndarray, list[np.ndarray]]) -> pa.Table:
        keys, beside = found
        cuts = bucket_cuts(keys, buckets)
        own = np.flatnonzero(np.diff(cuts))
        blobs = [pack_arrays(keys[cuts[b] : cuts[b + 1]], *(a[cuts[b] : cuts[b + 1]] for a in beside)) for b in own]
        return pa.table({"bucket": pa.array(own, pa.int32()), "number": pa.array([number] * len(own), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    if answers is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield from rows(r["number"], question(read_block(r["folder"], r["block"]))).to_batches()
            let_go()

        # One block after the other: a row of names stands for MBs of text.
        return spread(names).mapInArrow(run, "bucket int, number long, blob binary")

    def again(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        return rows(r["number"], question(read_block(r["folder"], r["block"]), answered(right)))

    return _side_by_side(names, answers, blocks).applyInArrow(again, "bucket int, number long, blob binary")


def _tasks(blocks: int) -> int:
    """A task for every three blocks: their rows are few and large, so adaptive
    coalescing, which goes by bytes, would leave too few tasks."""
    return max(1, -(-blocks // 3))


def _beside(names: DataFrame, answers: DataFrame, tasks: int, by: str):
    return names.repartition(tasks, by).groupBy(by).cogroup(answers.repartition(tasks, by).groupBy(by))


def _side_by_side(names: DataFrame, answers: DataFrame, blocks: int):
    return _beside(names, answers, _tasks(blocks), "number")


def spread(names: DataFrame) -> DataFrame:
    """Names dealt out over tasks of a few blocks each."""
    return names.repartition(_tasks(names.count()))


def answered(answers: pa.Table) -> list[bytes]:
    """The blobs of a block's answers in the order of buckets."""
    order = np.argsort(answers.column("bucket").to_numpy())
    blobs = answers.column("blob").to_pylist()
    return [blobs[i] for i in order]


def merge(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]], name: str, buckets: int, names: DataFrame | None = None, chunks: int = 0) -> DataFrame:
    """Answer each bucket: ``answer`` gets the blobs of all blocks and returns
    one for each, in the same order. A task has one bucket. The result is stored.
    With ``chunks``, it gets and answers theirs, a byte for each key, and the blocks
    that ``names`` lists are answered with one blob each."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("number")  # the same whatever the order of arrival
        out = answer(group.column("blob").to_pylist())
        trim_memory()
        return group.set_column(group.column_names.index("blob"), "blob", pa.array(out, pa.binary()))

    merged = asked.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(run, asked.schema)
    return staged(_deal_out(merged, names, chunks) if chunks else merged, name)


def finish(names: DataFrame, answers: list[DataFrame], last: Callable[..., pa.Table], schema: str, blocks: int) -> DataFrame:
    """Rows that ``last`` makes of each block and all its answers: it gets the
    block's table and one list of blobs per DataFrame of answers."""
    all_answers, n_answers = None, len(answers)
    for i, a in enumerate(answers):
        a = a.withColumn("kind", F.lit(i))
        all_answers = a if all_answers is None else all_answers.unionByName(a)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([])
        r = left.to_pylist()[0]
        kind = right.column("kind").to_numpy()
        parts = [answered(right.filter(pa.array(kind == i))) for i in range(n_answers)]
        out = last(read_block(r["folder"], r["block"]), *parts)
        let_go()
        return out

    return _side_by_side(names, all_answers, blocks).applyInArrow(run, schema)
