"""Helpers that every operator of this subpackage shares.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` (shared by all executors), never to a machine-local
folder on a cluster; only a local session that names none gets a folder of its own.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch hands to a Python worker at most, so
#: that a few very long texts cannot fill a worker's memory.
ARROW_ROWS = "512"
ARROW_BYTES = str(8 << 20)


def trim_memory() -> None:
    """Give what a worker has freed back to the system; Arrow and the C library
    otherwise keep it, and an idle worker holds on to what its largest block took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has its own ways


def bound_arrow(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session as a URI, without a trailing slash."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return (where if "://" in where or where.startswith("file:") else "file://" + where).rstrip("/")


#: Paths handed out in this thread while ``recorded`` is in force.
_recording = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_recording, "lists", []):
        paths.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are handed out within, for later removal."""
    paths: list[str] = []
    before = getattr(_recording, "lists", [])
    _recording.lists = [*before, paths]
    try:
        yield paths
    finally:
        _recording.lists = before


def remove_unused(paths: list[str], by: DataFrame) -> None:
    """Remove what was stored below ``paths``, unless ``by`` still reads any of it."""
    names = [p.rsplit("/", 1)[1] for p in paths]
    if any(n in f for f in by.inputFiles() for n in names):
        return
    for path in paths:
        fs, where = open_fs(path)
        if fs.get_file_info(where).type == pafs.FileType.Directory:
            fs.delete_dir(where)
    paths.clear()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for use in workers as on the driver."""
    return pafs.FileSystem.from_uri(uri)


def fold(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus`` (null ids count as '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
