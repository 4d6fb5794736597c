"""WARC archives with revisit records, and their two-level capture index.

Archives hold one gzip member per record. Index lines, sorted by reversed-host
URL key, lie in gzip blocks of ``BLOCK_LINES`` lines, one file per key range; a
sparse directory beside each such file has the first key, place and size of each
block. A lookup finds the range, binary-searches its directory, reads a block,
binary-searches that, and reads the record's bytes alone.

Writers choose a new file name in each attempt, and only the names of attempts
that were committed reach the manifest, so a lost executor leaves at most files
that nothing refers to.

Defined results: a null payload is empty; among equal payloads the row with the
largest page_id is the response (rows that repeat it are responses as well), and
the others revisit it; null page_ids come last; a null url is the key of the empty URL; an
empty table gives no rows and an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound_arrow, new_path, open_fs, staged

BLOCK_LINES = 3000
RECORDS = "page_id long, url string, key string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, place long, size long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key with the host's labels reversed: com,example)/path?query."""
    try:
        u = urlsplit((url or "").strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return (url or "").strip().lower()
    host = host.removeprefix("www.")
    port = f":{port}" if port and port not in (80, 443) else ""
    query = "?" + "&".join(sorted(u.query.split("&"))) if u.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path.lower() or "/") + query.lower()


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, sha: str, length: int, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit carries no payload, but
    the digest and length of the one it stands for."""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Target-URI": re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{sha}",
        "X-Payload-Length": str(length),
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    body = payload if kind == "response" else b""
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-Id"] = "" if refers_to is None else str(refers_to)
        head["WARC-Refers-To-Target-URI"] = re.sub(r"[\r\n]", "", refers_url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head["Content-Type"] = "application/http; msgtype=response"
    head["Content-Length"] = str(len(http) + len(body))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    whole = lines.encode() + http + body + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    whole = gzip.decompress(member)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    content = rest[: int(fields["Content-Length"])]
    return fields, content.partition(b"\r\n\r\n")[2]


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload length and digest, record_type and refers_to.

    Only (digest, page_id) is aggregated; a digest that a third of all rows
    share is one row after the partial aggregation, and the join back leaves the
    large side to adaptive skew splitting."""
    bound_arrow(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, n = [], []
            for payload in batch.column(2):
                data = payload.as_buffer()
                sha.append(digest(data))
                n.append(data.size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["page_id", "url", "payload", "payload_bytes", "payload_digest"])

    known = base.mapInArrow(measure, "page_id long, url string, payload binary, payload_bytes long, payload_digest string")
    # Payloads under the least length are never revisits: each is its own class.
    shared = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest"))
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    first = known.where(shared.isNotNull()).groupBy(shared.alias("payload_digest")).agg(F.max(rank).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = known.join(first.hint("shuffle_hash"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id",
        "url",
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per page below ``path`` and return the manifest (RECORDS)."""
    root = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(root)
        fs.create_dir(where, recursive=True)
        out, name, place = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or place >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{where}/{name}", compression=None)
                    member = record(r["page_id"], r["url"], r["record_type"], r["payload"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r["refers_url"])
                    out.write(member)
                    rows.append((r["page_id"], r["url"], url_key(r["url"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], name, place, len(member)))
                    place += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema(list(zip(_NAMES, _TYPES))))
        finally:
            if out is not None:
                out.close()

    return staged(decide(pages, least_bytes).mapInArrow(run, RECORDS), "warc-manifest")


_NAMES = [x.split(" ")[0] for x in RECORDS.split(", ")]
_TYPES = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORDS.split(", ")]


@dataclass
class CaptureIndex:
    """``ranges``: a row per key range (first key, file, directory), as many as
    the sort had partitions; block directories stay in the shared folder."""

    path: str
    archives: str
    ranges: list[tuple[str, str, str]]

    @staticmethod
    def build(manifest: DataFrame, path: str, archives: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, where = open_fs(path)
            fs.create_dir(where, recursive=True)
            name, place, block, entries, out = uuid.uuid4().hex, 0, [], [], None

            def flush() -> None:
                nonlocal place, out
                if block:
                    if out is None:
                        out = fs.open_output_stream(f"{where}/{name}.cdx.gz", compression=None)
                    data = gzip.compress("".join(x + "\n" for x in block).encode(), 6, mtime=0)
                    out.write(data)
                    entries.append([json.loads(block[0].partition(" ")[0]), place, len(data), len(block)])
                    place += len(data)
                    block.clear()

            for batch in batches:
                for r in batch.to_pylist():
                    block.append(json.dumps(r["key"], ensure_ascii=True).replace(" ", "\\u0020") + " " + json.dumps({k: r[k] for k in ("page_id", "url", "record_type", "refers_to", "file", "place", "size")}))
                    if len(block) >= block_lines:
                        flush()
            flush()
            if out is not None:
                out.close()
                with fs.open_output_stream(f"{where}/{name}.dir.json", compression=None) as d:
                    d.write(json.dumps(entries).encode())
                yield pa.RecordBatch.from_pydict({"first": [entries[0][0]], "file": [f"{name}.cdx.gz"], "directory": [f"{name}.dir.json"]})

        lines = manifest.select("key", "page_id", "url", "record_type", "refers_to", "file", "place", "size")
        ordered = lines.repartitionByRange("key", "page_id", "place").sortWithinPartitions("key", "page_id", "place")
        made = staged(ordered.mapInArrow(run, "first string, file string, directory string"), "capture-ranges")
        return CaptureIndex(path, archives, sorted((r.first, r.file, r.directory) for r in made.select(F.col("first").alias("first"), "file", "directory").collect()))

    def lookup(self, url: str) -> list[dict]:
        """Captures of a URL, found by binary search over ranges, then blocks."""
        fs, where = open_fs(self.path)
        key, firsts, found = url_key(url), [r[0] for r in self.ranges], []
        for _, file, directory in self.ranges[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
            with fs.open_input_file(f"{where}/{directory}") as d:
                blocks = json.loads(d.read())
            starts = [b[0] for b in blocks]
            with fs.open_input_file(f"{where}/{file}") as f:
                for _, place, size, _n in blocks[max(0, bisect.bisect_left(starts, key) - 1) : bisect.bisect_right(starts, key)]:
                    f.seek(place)
                    lines = gzip.decompress(f.read(size)).decode().splitlines()
                    keys = [json.loads(x.partition(" ")[0]) for x in lines]
                    found += [json.loads(x.partition(" ")[2]) for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
        return found

    def fetch(self, entry: dict) -> tuple[dict[str, str], bytes]:
        """Range-read one record."""
        fs, where = open_fs(self.archives)
        with fs.open_input_file(f"{where}/{entry['file']}") as f:
            f.seek(entry["place"])
            return parse(f.read(entry["size"]))

    def read_all(self, spark) -> DataFrame:
        """Every indexed record, read from the archives through the index: a row
        per block goes to the executors, which order a block's reads by file and
        place."""
        index, archives = self.path, self.archives

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, where = open_fs(index)
            for batch in batches:
                for r in batch.to_pylist():
                    with fs.open_input_file(f"{where}/{r['directory']}") as d:
                        found = json.loads(d.read())
                    yield pa.RecordBatch.from_pydict({"file": [r["file"]] * len(found), "place": [b[1] for b in found], "size": [b[2] for b in found]})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, where = open_fs(index)
            stored, held = open_fs(archives)
            for batch in batches:
                for b in batch.to_pylist():
                    with fs.open_input_file(f"{where}/{b['file']}") as f:
                        f.seek(b["place"])
                        entries = [json.loads(x.partition(" ")[2]) for x in gzip.decompress(f.read(b["size"])).decode().splitlines()]
                    entries.sort(key=lambda e: (e["file"], e["place"]))
                    rows, name, f = [], None, None
                    for e in entries:
                        if e["file"] != name:
                            if f is not None:
                                f.close()
                            name, f = e["file"], stored.open_input_file(f"{held}/{e['file']}")
                        f.seek(e["place"])
                        fields, payload = parse(f.read(e["size"]))
                        sha, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            if digest(payload) != sha or len(payload) != n:
                                raise ValueError(f"damaged record at {e['file']}:{e['place']}")
                        page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id", "")
                        rows.append((int(page) if page else None, fields["WARC-Target-URI"], n, sha, fields["WARC-Type"], int(refers) if refers else None))
                    if f is not None:
                        f.close()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        ranges = spark.createDataFrame([(f, d) for _, f, d in self.ranges], "file string, directory string")
        listed = ranges.repartition(max(1, min(len(self.ranges), 200))).mapInArrow(blocks, "file string, place long, size long")
        many = max(1, spark.sparkContext.defaultParallelism * 2)
        return listed.repartition(many, "file", "place").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least_bytes: int = 0) -> CaptureIndex:
    """Write archives and index below the shared folder."""
    spark = pages.sparkSession
    where = new_path(spark, "warc")
    manifest = write_archives(pages, f"{where}/archives", least_bytes)
    return CaptureIndex.build(manifest, f"{where}/index", f"{where}/archives")


def first_captures(index_rows: DataFrame) -> DataFrame:
    """The first capture of each URL (smallest page_id), of ``read_all``'s rows."""
    order = Window.partitionBy("url").orderBy(F.col("page_id").asc_nulls_last())
    return index_rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
