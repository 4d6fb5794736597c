"""Near-duplicate classes by SimHash signatures in an LSH forest.

Words are runs of ASCII letters (case folded), digits and non-ASCII characters;
five words make a shingle (a text of fewer, but not none, is one shingle). Each
text gets a 128-bit SimHash of its distinct shingles.

A forest of tries, each over its own random order of the signature's bits,
brings signatures together that share a prefix. The prefix starts at the depth
that the density of all calls for (about ``NODE_ROWS`` signatures a node) and is
climbed to shorter ones until the tries allowed reach the target recall at the
least similarity, summed over the distances that pairs have there. From there each
node adapts to its own density: one of ``SPLIT_ROWS`` or more is split by tries of
its own over the bits that its prefix left, as deep as it is dense, and as many as
keep ``SPLIT_RECALL`` of its pairs together. Pairs within ``DISTANCE`` are held
against each other by sketches (one-permutation MinHash, ``sketches``), and those
that may be similar enough by the exact Jaccard similarity of their shingle sets.

Signatures of few shingles say little. A text of at most ``FEW`` is in no trie: it
is compared with all texts that share one of the smallest hashes of its set, of
which any two sets as similar have one in common, so none of its links is missed.

No node's pairs are all emitted. In a first round each text names its nearest two
in a node (in crowded nodes also the nearest of a few leaders); verified links form
components. Texts with more near ones than they named go into a second round with
their nodes: there pairs of different components are compared, all of them, so that
no link between components is left out.

Defined results: texts that are equal (null counts as empty) form one class;
class_id is the smallest doc_id of the class, null if all are null; rows with
equal doc_id each get a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import U64, Rolling, let_go, mix, read_block, spread, text_bytes, write_blocks
from lodestone.llm.common import open_fs, staged

WORDS = 5
SIMILARITY = 0.8
BITS = 128
RECALL = 0.995
NODE_ROWS = 2048
MOST_TRIES = 256
#: Nodes from this size on are split, keeping so many of their pairs together, as
#: long as the list of such nodes is this short (the list goes to every task).
SPLIT_ROWS = 65_536
SPLIT_RECALL = 0.9995
SPLIT_NODES = 500_000
CROWD = 16_384
ROW_BITS = 24
#: Short texts a bucket, each there with up to a fifth of its shingles.
FEW_ROWS = 20_000
FEW = 32
BLOCK_BYTES = 2 << 20
#: Places of a sketch, and the standard deviations by which it may fall short.
PLACES = 512
SHORT = 4.5
#: Share of bits in which texts at the least similarity differ (angle of sets
#: with cosine 2J / (1 + J)), and the distance that 0.9988 of them keep within.
DIFFER = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
DISTANCE = math.ceil(BITS * DIFFER + 2.9 * math.sqrt(BITS * DIFFER * (1 - DIFFER)))

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def shingles(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, how many
    each text has, and 128-bit hashes of the whole texts."""
    data, starts, ends = text_bytes(texts)
    lower = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[lower].astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    word = Rolling(lower)(first, last)
    row = np.searchsorted(ends, first, side="right")
    n = np.bincount(row, minlength=len(starts))
    stop = np.cumsum(n)
    width = np.minimum(WORDS, n)[row]  # short texts: all their words
    value = np.zeros(len(word), dtype=U64)
    for k in range(WORDS):
        use = (width > k)[: len(word) - k]
        value[: len(word) - k] += np.where(use, word[k:] * U64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)), U64(0))
    fits = np.arange(len(word)) + width <= stop[row]
    value, row = mix(value[fits]), row[fits]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])] if len(value) else np.zeros(0, bool)
    whole = b"".join([xxhash.xxh3_128_digest(data[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())])
    return value[new], np.bincount(row[new], minlength=len(starts)), np.frombuffer(whole, "<i8").reshape(-1, 2)


def signatures(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128-bit SimHash of each text, as two 64-bit words. Ones are counted in
    the eight byte lanes of a word, in runs of at most 255 shingles."""
    out = np.zeros((len(counts), 2), dtype=U64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    parts = -(-counts[has] // 255)
    start = np.cumsum(counts[has]) - counts[has]
    cut = np.repeat(start, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    of_text = np.cumsum(parts) - parts
    for half, h in enumerate((value, mix(value + U64(0x632BE59BD9B4E019)))):
        for k in range(8):
            lanes = np.add.reduceat((h >> U64(k)) & U64(0x0101010101010101), cut)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), of_text, axis=0, dtype=np.int64)
            most = 2 * ones > counts[has][:, None]
            for lane in range(8):
                out[has, half] |= most[:, lane].astype(U64) << U64(8 * lane + k)
    return out


def sketches(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """256 bytes for each text: in each of PLACES ranges of hashes, four bits of
    the smallest shingle there, or 0 if there is none. Two texts agree in a place
    that either fills as often as they are similar, or by chance more often."""
    key = np.repeat(np.arange(len(counts)) * PLACES, counts) + (value >> U64(64 - PLACES.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    out = np.zeros(len(counts) * PLACES, np.uint8)
    out[key[first]] = (value[first] & U64(0xFFFF)) % U64(15) + U64(1)
    out = out.reshape(len(counts), PLACES // 2, 2)
    return out[:, :, 0] | out[:, :, 1] << 4


def may_be_similar(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Whether texts with these sketches may be as similar; of those that are,
    SHORT deviations' worth (some three in a million) at most are denied."""
    filled = same = 0
    for a, b in ((one & 15, other & 15), (one >> 4, other >> 4)):
        filled += np.count_nonzero(a | b)
        same += np.count_nonzero((a == b) & (a > 0))
    return same >= similarity * filled - SHORT * math.sqrt(filled * similarity * (1 - similarity))


def _signed(names: DataFrame, most: int) -> DataFrame:
    """Per row of each block: node (24 bits for the row, the block's number above
    them), doc_id, hash of the text (h1, h2), signature (s1, s2), n_shingles, and
    the set itself (few) if it has at most so many. The sketches of a block are
    stored beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                table = read_block(r["folder"], r["block"])
                value, counts, whole = shingles(table.column("text"))
                sig = signatures(value, counts)
                _store_sketches(r, sketches(value, counts))
                columns = {"node": pa.array((r["number"] << ROW_BITS) + np.arange(len(counts))), "doc_id": table.column("doc_id").combine_chunks()}
                for name, a in (("h1", whole[:, 0]), ("h2", whole[:, 1]), ("s1", sig[:, 0]), ("s2", sig[:, 1])):
                    columns[name] = pa.array(np.ascontiguousarray(a).view(np.int64))
                columns["n_shingles"] = pa.array(counts, pa.int64())
                ends = np.cumsum(counts)
                columns["few"] = pa.array([value[e - n : e].tobytes() if 0 < n <= most else None for n, e in zip(counts.tolist(), ends.tolist())], pa.binary())
                yield from pa.table(columns).to_batches()
        let_go()

    return staged(spread(names).mapInArrow(run, "node long, doc_id long, h1 long, h2 long, s1 long, s2 long, n_shingles long, few binary"), "signatures")


def _store_sketches(place: dict, found: np.ndarray) -> None:
    """Written aside and moved, so that a repeated task leaves the same file."""
    fs, where = open_fs(place["folder"])
    aside = f"{where}/{place['block']}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside, compression=None) as out:
        out.write(found.tobytes())
    fs.move(aside, f"{where}/{place['block']}.sketches")


def _read_sketches(place: dict, rows: np.ndarray) -> dict[int, np.ndarray]:
    fs, where = open_fs(place["folder"])
    with fs.open_input_file(f"{where}/{place['block']}.sketches") as f:
        every = np.frombuffer(f.read(), np.uint8).reshape(-1, PLACES // 2)
    return {r: every[r] for r in np.unique(rows).tolist()}


def recall(depth: int, tries: int, bits: int = BITS) -> float:
    """Chance that a pair at the least similarity is near enough and shares a
    prefix in a trie over so many bits. A pair's distance is the same in all tries,
    so the chance is that of each distance, with a prefix drawn without replacement."""
    chance = 0.0
    for h in range(DISTANCE + 1):
        share = math.comb(BITS, h) * DIFFER**h * (1 - DIFFER) ** (BITS - h)
        chance += share * (1 - (1 - math.comb(max(0, bits - h), depth) / math.comb(bits, depth)) ** tries)
    return chance


def tries_at(depth: int, target: float = RECALL, bits: int = BITS) -> int:
    """The fewest tries that reach the target with prefixes of this depth."""
    high = 1
    while recall(depth, high, bits) < target:
        high *= 2
    return bisect.bisect_left(range(high + 1), True, lo=1, key=lambda t: recall(depth, t, bits) >= target)


def forest_shape(n: int) -> tuple[int, int]:
    """Depth of the prefix and number of tries for n signatures: from the depth
    that leaves NODE_ROWS in a node, climb until MOST_TRIES reach the recall."""
    depth = max(1, math.ceil(math.log2(max(2, n / NODE_ROWS))))
    while depth > 1 and (depth > BITS - DISTANCE or recall(depth, MOST_TRIES) < RECALL):
        depth -= 1
    return depth, tries_at(depth)


def _orders(tries: int) -> list[list[int]]:
    """Each trie's order of the bits."""
    rng = np.random.default_rng(20)
    return [rng.permutation(BITS).tolist() for _ in range(tries)]


def _bits(s1: np.ndarray, s2: np.ndarray, start: int, bits: list[int]) -> np.ndarray:
    key = np.full(len(s1), start, dtype=U64)
    for bit in bits:
        word = s1 if bit < 64 else s2
        key = (key << U64(1)) | ((word >> U64(bit & 63)) & U64(1))
    return key


def _prefixes(s1: np.ndarray, s2: np.ndarray, depth: int, tries: int) -> Iterator[np.ndarray]:
    for t, order in enumerate(_orders(tries)):
        yield _bits(s1, s2, t, order[:depth])


def split_shape(rows: int, depth: int) -> tuple[int, int]:
    """Depth and number of the tries into which a node at ``depth`` is split."""
    most = BITS - depth - DISTANCE
    deeper = min(most, math.ceil(math.log2(rows / NODE_ROWS)))
    while deeper > 1 and recall(deeper, MOST_TRIES, BITS - depth) < recall(1, MOST_TRIES, BITS - depth) * SPLIT_RECALL:
        deeper -= 1
    # Pairs beyond DISTANCE are not looked for, so they don't count as lost.
    return deeper, tries_at(deeper, recall(1, MOST_TRIES, BITS - depth) * SPLIT_RECALL, BITS - depth)


def split_keys(key: int, shape: tuple[int, int], depth: int, order: list[int], s1: np.ndarray, s2: np.ndarray) -> Iterator[np.ndarray]:
    """For each trie of a split node: which of its nodes each signature is in."""
    deeper, tries = shape
    rng = np.random.default_rng([20, key])
    for t in range(tries):
        bits = [order[depth + i] for i in rng.permutation(BITS - depth)[:deeper].tolist()]
        yield mix(_bits(s1, s2, t + 1, bits) ^ mix(np.full(len(s1), key ^ 0x5851F42D4C957F2D, dtype=U64)))


def dense_nodes(nodes: DataFrame, shape: tuple[int, int], rows: int | None = None) -> dict[int, int]:
    """Keys of all nodes of so many rows (and none of under half as many), with
    about their sizes. Each part of a task counts for itself and names only what is
    frequent there: rows / 2 of a node cannot hide below what the parts leave out."""
    depth, tries = shape
    rows, part = rows or SPLIT_ROWS, 1 << 18
    parts = nodes.rdd.getNumPartitions() + nodes.count() // part
    least = max(1, rows // (2 * parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def named() -> Iterator[pa.RecordBatch]:
            s1, s2 = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for key in _prefixes(s1, s2, depth, tries):
                keys, count = np.unique(key, return_counts=True)
                often = count >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(count[often])], names=["key", "n"])

        for batch in batches:
            held.append([batch.column(c).to_numpy().view(U64) for c in ("s1", "s2")])
            n += batch.num_rows
            if n >= part:
                yield from named()
                held, n = [], 0
        if n:
            yield from named()

    if nodes.count() < rows:
        return {}
    sums = nodes.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * 2 >= rows)
    found = sums.limit(SPLIT_NODES + 1).collect()
    # Where all is dense, nodes stay whole: they are compared all the same.
    return {r.key: r.n for r in found} if len(found) <= SPLIT_NODES else {}


def _far(a1, a2, b1, b2) -> np.ndarray:
    return np.bitwise_count(a1[:, None] ^ b1[None]) + np.bitwise_count(a2[:, None] ^ b2[None])


def _nearest(s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First round within a node: (i, j) where i named j, and which have more near
    ones than they named."""
    m = len(s1)
    out_i, out_j, more = [np.zeros(0, int)], [np.zeros(0, int)], np.ones(m, bool)
    if m <= CROWD:
        step = max(1, 131_072 // m)
        for start in range(0, m, step):
            d = _far(s1[start : start + step], s2[start : start + step], s1, s2)
            own = np.arange(len(d))
            d[own, start + own] = 255
            near = np.count_nonzero(d <= DISTANCE, axis=1)
            more[start : start + step] = near > 2
            some = np.flatnonzero(near)
            d = d[some]
            for k in range(2):
                j = d.argmin(axis=1)
                ok = near[some] > k
                out_i.append(start + some[ok])
                out_j.append(j[ok])
                d[np.arange(len(d)), j] = 255
        return np.concatenate(out_i), np.concatenate(out_j), more
    left = np.arange(m)
    for _ in range(16):  # leaders, each from those that no leader is near yet
        if not len(left):
            break
        lead = left[:1]
        d = _far(s1[left], s2[left], s1[lead], s2[lead])[:, 0]
        near = (d <= DISTANCE) & (left != lead[0])
        out_i.append(left[near])
        out_j.append(np.repeat(lead, near.sum()))
        left = left[(d > DISTANCE // 2) & (left != lead[0])]
    order = np.lexsort((s2, s1))
    for step in (1, 2):
        a, b = order[:-step], order[step:]
        ok = np.bitwise_count(s1[a] ^ s1[b]) + np.bitwise_count(s2[a] ^ s2[b]) <= DISTANCE
        out_i.append(a[ok])
        out_j.append(b[ok])
    return np.concatenate(out_i), np.concatenate(out_j), more


def _across(s1: np.ndarray, s2: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second round within a node: all near pairs of different components. The
    largest component is never compared with itself."""
    values, at, sizes = np.unique(label, return_inverse=True, return_counts=True)
    if len(values) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    rank = np.argsort(np.argsort(-sizes, kind="stable"))[at]
    rest = np.flatnonzero(rank > 0)
    out_i, out_j = [np.zeros(0, int)], [np.zeros(0, int)]
    step = max(1, 131_072 // len(s1))
    for k in range(0, len(rest), step):
        r = rest[k : k + step]
        x, y = np.nonzero((_far(s1[r], s2[r], s1, s2) <= DISTANCE) & (rank[r][:, None] > rank[None]))
        out_i.append(y)  # of the larger component; the other one's set is sent to it
        out_j.append(r[x])
    return np.concatenate(out_i), np.concatenate(out_j)


def _groups(table: pa.Table, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each node of a bucket, in a fixed order."""
    key = table.column("key").to_numpy()
    order = np.lexsort((table.column("node").to_numpy(), key))
    key, values = key[order], [table.column(c).to_numpy()[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key))
    for start, end in zip(cuts[:-1], cuts[1:]):
        if end - start > 1:
            yield [v[start:end] for v in values]


def _buckets(spark: SparkSession, tries: int) -> int:
    """Enough that a bucket holds about as many rows as a partition of signatures."""
    return tries * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _named(nodes: DataFrame, shape: tuple[int, int], dense: dict[int, int]) -> DataFrame:
    """First round in all nodes of the tries over nodes(node, s1, s2). Rows with b:
    a named b. Rows without: a stays for the second round in the node ``key``."""
    depth, tries = shape
    hot = np.array(sorted(dense), dtype=np.int64)
    shapes = {key: split_shape(n, depth) for key, n in dense.items()}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(tries)
        for batch in batches:
            s1, s2 = (batch.column(c).to_numpy().view(U64) for c in ("s1", "s2"))
            row = lambda key, rows: pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *rows.columns], names=["key", "node", "s1", "s2"])
            for t, key in enumerate(_prefixes(s1, s2, depth, tries)):
                split = np.isin(key.view(np.int64), hot)
                if not split.any():
                    yield row(mix(key), batch)
                    continue
                yield row(mix(key[~split]), batch.filter(pa.array(~split)))
                for k in np.unique(key[split].view(np.int64)).tolist():
                    own = key.view(np.int64) == k
                    rows = batch.filter(pa.array(own))
                    for deeper in split_keys(k, shapes[k], depth, orders[t], s1[own], s2[own]):
                        yield row(deeper, rows)

    def compare(group: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stay = [np.zeros((0, 4), np.int64)]
        for key, node, s1, s2 in _groups(group, ["key", "node", "s1", "s2"]):
            x, y, more = _nearest(s1.view(U64), s2.view(U64))
            a.append(node[x])
            b.append(node[y])
            if more.any():
                stay.append(np.stack([node[more], key[more], s1[more], s2[more]], axis=1))
        a, b, stay = np.concatenate(a), np.concatenate(b), np.concatenate(stay)
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"a": np.concatenate([a, stay[:, 0]]), "b": pa.chunked_array([pa.array(b), pa.nulls(len(stay), pa.int64())]), **{c: pa.chunked_array([none, pa.array(np.ascontiguousarray(stay[:, i]))]) for i, c in ((1, "key"), (2, "s1"), (3, "s2"))}})

    keys = nodes.select("node", "s1", "s2").mapInArrow(keyed, "key long, node long, s1 long, s2 long")
    bucket = F.pmod("key", F.lit(_buckets(nodes.sparkSession, tries))).alias("bucket")
    return staged(keys.groupBy(bucket).applyInArrow(compare, "a long, b long, key long, s1 long, s2 long"), "named")


def _between(stay: DataFrame, labels: DataFrame, tries: int) -> DataFrame:
    """Second round: pairs a, b of different components within the nodes of
    stay(a, key, s1, s2); a text without a label is a component of its own."""

    def compare(group: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for node, s1, s2, label in _groups(group, ["node", "s1", "s2", "label"]):
            x, y = _across(s1.view(U64), s2.view(U64), label)
            a.append(node[x])
            b.append(node[y])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    known = stay.withColumnRenamed("a", "node").join(labels, "node", "left").select("key", "node", "s1", "s2", F.coalesce("label", "node").alias("label"))
    bucket = F.pmod("key", F.lit(_buckets(stay.sparkSession, tries))).alias("bucket")
    return known.groupBy(bucket).applyInArrow(compare, "a long, b long").distinct()


def _spanning(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that span the components of these sets, each set compared with all
    that no link has reached yet."""
    sizes = np.array([len(x) for x in sets])
    value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    waiting, left = np.ones(len(sets), bool), len(sets)
    out_i, out_j = [], []
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        left -= 1
        reached = [root]
        while reached and left:
            i = reached.pop()
            places = zip(np.searchsorted(value, sets[i]).tolist(), np.searchsorted(value, sets[i], side="right").tolist())
            both = np.bincount(np.concatenate([row[x:y] for x, y in places]), minlength=len(sets))
            near = np.flatnonzero(waiting & (both >= similarity * (sizes[i] + sizes - both))).tolist()
            waiting[near] = False
            left -= len(near)
            reached += near
            out_i += [i] * len(near)
            out_j += near
    return out_i, out_j


def _few_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b of sets(node, few) that span the components of all links among
    them. Of n hashes in order, the first n - ceil(similarity * n) + 1 cannot all
    be missing from a set as similar."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = batch.column("few").to_pylist()
            sizes = np.array([len(x) // 8 for x in few], dtype=np.int64)
            first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
            row = np.repeat(np.arange(len(few)), first)
            at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(first) - first), first) + np.arange(first.sum())
            key = np.frombuffer(b"".join(few), np.int64)[at]
            yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(pa.array(row)) for c in batch.columns)], names=["key", "node", "few"])

    def compare(group: pa.Table) -> pa.Table:
        key, node = group.column("key").to_numpy(), group.column("node").to_numpy()
        order = np.lexsort((node, key))
        few = group.column("few")
        cuts = np.append(np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]), len(key))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end - start > 1:
                own = order[start:end]
                i, j = _spanning([np.frombuffer(x, U64) for x in few.take(pa.array(own)).to_pylist()], similarity)
                a.append(node[own][i])
                b.append(node[own][j])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    keys = sets.select("node", "few").mapInArrow(keyed, "key long, node long, few binary")
    buckets = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets.count() // FEW_ROWS)
    return keys.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(compare, "a long, b long").distinct()


def _sets(place: dict, rows: np.ndarray) -> dict[int, np.ndarray]:
    """Shingle sets of rows of a block, by row."""
    rows = np.unique(rows)
    table = read_block(place["folder"], place["block"]).select(["text"]).take(pa.array(rows))
    value, counts, _ = shingles(table.column("text"))
    return dict(zip(rows.tolist(), np.split(value, np.cumsum(counts)[:-1])))


def _compared(names: DataFrame, pairs: DataFrame, load: Callable[[dict, np.ndarray], dict[int, np.ndarray]], alike: Callable[[np.ndarray, np.ndarray], bool], kind: str) -> DataFrame:
    """The pairs that ``alike`` holds for, given what ``load`` reads of the blocks
    of both. What b has is sent once to each block that has partners of it."""
    row = (1 << ROW_BITS) - 1

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"number": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "set": pa.array([], pa.binary())})
        b = right.column("b").to_numpy()
        sets = load(left.to_pylist()[0], b & row)
        return pa.table({"number": right.column("to"), "a": pa.nulls(len(b), pa.int64()), "b": pa.array(b), "set": pa.array([sets[x].tobytes() for x in (b & row).tolist()], pa.binary())})

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        edges = right.filter(right.column("a").is_valid())
        if left.num_rows and edges.num_rows:
            sent = right.filter(right.column("a").is_null())
            theirs = dict(zip(sent.column("b").to_pylist(), sent.column("set").to_pylist()))
            a_all, b_all = edges.column("a").to_numpy(), edges.column("b").to_numpy()
            ours = load(left.to_pylist()[0], a_all & row)
            out = [(x, y) for x, y in zip(a_all.tolist(), b_all.tolist()) if alike(ours[x & row], np.frombuffer(theirs[y], kind))]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    block = lambda c: F.shiftrightunsigned(c, ROW_BITS)
    asked = pairs.select(block("a").alias("to"), "b").distinct().withColumn("number", block("b"))
    sets = names.groupBy("number").cogroup(asked.groupBy("number")).applyInArrow(send, "number long, a long, b long, set binary")
    edges = pairs.select(block("a").alias("number"), "a", "b", F.lit(None).cast("binary").alias("set"))
    return names.groupBy("number").cogroup(sets.unionByName(edges).groupBy("number")).applyInArrow(judge, "a long, b long")


def _verify(names: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are as similar. Sketches go first, so that sets
    are sent for few that are not."""

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
        return both >= similarity * (len(a) + len(b) - both)

    likely = staged(_compared(names, pairs, _read_sketches, lambda a, b: may_be_similar(a, b, similarity), "u1"), "likely")
    return _compared(names, likely, _sets, similar, "<u8")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of the
    edges (a, b): alternating large and small stars until nothing changes."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = linked.select("a", F.col("m").alias("b")).unionByName(linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = staged(small.distinct(), "edges")
        again = mark(now)
        if again == seen:
            break
        seen = again
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _members(documents: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The blocks' names, and node, doc_id, class (a node) of every row."""
    names = write_blocks(documents, block_bytes=BLOCK_BYTES)
    rows = _signed(names, int(FEW / similarity + 1e-9))
    exact = rows.groupBy("h1", "h2").agg(F.min(F.struct("node", "s1", "s2", "n_shingles", "few")).alias("first"))
    texts = staged(exact.select("h1", "h2", "first.*"), "texts")
    short = _few_links(texts.where("few is not null"), similarity)
    nodes = texts.where(F.col("n_shingles") > FEW).select("node", "s1", "s2")
    shape = forest_shape(nodes.count())
    named = _named(nodes, shape, dense_nodes(nodes, shape))
    pairs = staged(named.where("b is not null").select("a", "b").distinct(), "pairs")
    linked = staged(_verify(names, pairs, similarity).unionByName(short), "links")
    first = staged(components(linked), "components")
    more = _between(named.where("b is null").select("a", "key", "s1", "s2"), first, shape[1]).join(pairs, ["a", "b"], "left_anti")
    late = _verify(names, staged(more, "pairs"), similarity)
    # Links between components join their labels; what is within stays as it is.
    label = lambda c: first.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    of = lambda c: F.coalesce(f"{c}_label", c).alias(c)
    second = staged(components(late.join(label("a"), "a", "left").join(label("b"), "b", "left").select(of("a"), of("b"))), "components")
    moved = second.select(F.col("node").alias("label"), F.col("label").alias("final"))
    final = first.join(moved, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    final = final.unionByName(second.join(first, "node", "left_anti"))
    classes = texts.select("h1", "h2", "node").join(final, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("class"))
    return names, rows.join(classes, ["h1", "h2"]).select("node", "doc_id", "class")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_rows: one row per document."""
    _, member = _members(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), similarity)
    member = staged(member, "members")
    classes = member.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    return member.join(classes, "class").select("doc_id", "class_id", "class_rows")


def keep_first(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, without all but the one of each class that has
    the smallest doc_id (of rows that repeat it, one; ids that are null last)."""
    names, member = _members(documents, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("node").alias("node"))
    first = member.groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.node").alias("node"))
    row = (1 << ROW_BITS) - 1

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        r = left.to_pylist()[0]
        return read_block(r["folder"], r["block"]).take(pa.array(np.sort(right.column("node").to_numpy() & row)))

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(documents.schema).empty_table()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    kept = first.withColumn("number", F.shiftrightunsigned("node", ROW_BITS))
    return names.groupBy("number").cogroup(kept.groupBy("number")).applyInArrow(take, fields)
