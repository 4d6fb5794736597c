"""The index as Parquet snapshots.

A snapshot folder holds ``entries`` and the tables derived from them; the file
``CURRENT`` names the snapshot in force. Writers fill a new folder and replace
that file last, so readers never see half an index and no table is overwritten
while it is read. Derived tables carry the fingerprint of the entries they were
made from; a table that is missing, damaged or of another fingerprint is built again.
"""

from __future__ import annotations

import json
import logging
import struct
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import CorruptedIndex, IndexNotFound, SidecarFailed

log = logging.getLogger(__name__)

FORMAT = 1
ENTRIES = "entry_id long, hash string, author string, date timestamp, message string, diff_summary string, embedding array<float>"


@dataclass
class IndexMeta:
    model_version: str
    last_commit: str = "unknown"
    created_at: str = ""
    updated_at: str = ""
    total_commits: int = 0
    include_diffs: bool = True
    fingerprint: str = ""
    snapshot: str = ""
    format: int = FORMAT


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fingerprint(entries: DataFrame, meta: IndexMeta) -> str:
    """Changes with the number of entries, the model, the last commit, the mode,
    the first and last hash, and components of three vectors."""
    n = meta.total_commits
    wanted = sorted({0, n // 2, n - 1} if n else set())
    rows = {r.entry_id: r for r in entries.where(F.col("entry_id").isin(wanted)).select("entry_id", "hash", F.slice("embedding", 1, 8).alias("v")).collect()} if wanted else {}
    data = f"{n}|{meta.model_version}|{meta.last_commit}|{meta.include_diffs}|".encode()
    for i in wanted:
        if i in rows:
            data += (rows[i].hash if i in (0, n - 1) else "").encode() + b"".join(struct.pack("<f", x) for x in rows[i].v or [])
    return f"{fnv1a(data):016x}"


class IndexStorage:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path if "://" in path else "file://" + path
        self.fs, self.where = pafs.FileSystem.from_uri(self.path)

    def _at(self, meta: IndexMeta, table: str) -> str:
        return f"{self.path}/{meta.snapshot}/{table}"

    def exists(self) -> bool:
        return self.fs.get_file_info(f"{self.where}/CURRENT").type == pafs.FileType.File

    def meta(self) -> IndexMeta:
        if not self.exists():
            raise IndexNotFound()
        try:
            with self.fs.open_input_stream(f"{self.where}/CURRENT") as f:
                return IndexMeta(**json.loads(f.read()))
        except (ValueError, TypeError) as e:
            raise CorruptedIndex(str(e)) from None

    def load(self) -> tuple[DataFrame, IndexMeta]:
        meta = self.meta()
        return self.spark.read.schema(ENTRIES).parquet(self._at(meta, "entries")), meta

    def save(self, entries: DataFrame, meta: IndexMeta) -> IndexMeta:
        """Write a new snapshot, then make it the current one."""
        meta.snapshot = f"snapshot-{uuid.uuid4().hex}"
        columns = [c.split(" ")[0] for c in ENTRIES.split(", ")]
        entries.select(*columns).write.parquet(self._at(meta, "entries"))
        stored = self.spark.read.schema(ENTRIES).parquet(self._at(meta, "entries"))
        meta.total_commits = stored.count()
        meta.updated_at = now()
        meta.created_at = meta.created_at or meta.updated_at
        meta.fingerprint = fingerprint(stored, meta)
        self.fs.create_dir(self.where, recursive=True)
        temporary = f"{self.where}/CURRENT.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(json.dumps(asdict(meta)).encode())
        self.fs.move(temporary, f"{self.where}/CURRENT")
        return meta

    def derived(self, name: str, meta: IndexMeta, build, refresh: bool = False) -> tuple[DataFrame, bool]:
        """A derived table, and whether it had to be built. A table that is missing,
        stale or can't be read is built again; one that can't be stored is used as
        it was built, and only a warning tells."""
        marker = f"{self.where}/{meta.snapshot}/{name}.json"
        path = self._at(meta, name)
        if not refresh and (found := self._readable(marker, path, meta)) is not None:
            return found, False
        built, version = build(), uuid.uuid4().hex
        try:
            built.write.parquet(f"{path}-{version}")
            with self.fs.open_output_stream(marker) as f:
                f.write(json.dumps({"format": FORMAT, "fingerprint": meta.fingerprint, "version": version, "files": self._files(f"{path}-{version}")}).encode())
        except (OSError, Py4JJavaError, PySparkException) as e:
            log.warning("%s", SidecarFailed(f"{name}: {str(e).splitlines()[0]}").report())
            return built, True
        return self.spark.read.parquet(f"{path}-{version}"), True

    def _files(self, uri: str) -> dict[str, int]:
        """Names and sizes of a table's data files."""
        fs, where = pafs.FileSystem.from_uri(uri)
        found = fs.get_file_info(pafs.FileSelector(where, recursive=True))
        return {f.base_name: f.size for f in found if f.base_name.endswith(".parquet")}

    def _readable(self, marker: str, path: str, meta: IndexMeta) -> DataFrame | None:
        """The stored table, if its marker fits the entries, its files are those
        that were written, and their footers can be read."""
        try:
            with self.fs.open_input_stream(marker) as f:
                known = json.loads(f.read())
            if known.get("format") != FORMAT or known.get("fingerprint") != meta.fingerprint:
                return None
            uri = f"{path}-{known['version']}"
            if self._files(uri) != known.get("files"):
                return None
            return self.spark.read.option("mergeSchema", "true").parquet(uri)  # reads every footer
        except (OSError, ValueError, KeyError, AttributeError, Py4JJavaError, PySparkException):
            return None

    def size(self) -> float:
        """Size of the current snapshot in units of 1,024,000 bytes."""
        files = self.fs.get_file_info(pafs.FileSelector(f"{self.where}/{self.meta().snapshot}", recursive=True))
        return sum(f.size or 0 for f in files) / 1_024_000
