"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``; the last returns the packed
pieces. ``run`` writes each stage's result as Parquet to the shared folder and
hands the reread table on.

Defined results: an empty or null text is kept by every filter, but equal texts
are near duplicates of each other, so one empty document stays; removal of
repeated passages keeps the document itself, with n_chars counted anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, packing, repeats, simhash, toxicity
from lodestone.llm.common import fold, recorded, remove_unused, staged, table
from lodestone.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    lexicon = toxicity.fit(table(spark, sf_dir, "documents"), labels)
    return toxicity.score(docs, lexicon).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_PLAIN: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Intermediate files of the stage called last, by its place in the list.
_left: dict[int, list[str]] = {}


def _tidy(place: int, stage: Stage) -> Stage:
    """A stage for callers that write each result before they call the next one: it
    removes the intermediate files of the stage just before it, unless ``docs`` still
    reads them. What the last stage leaves stays, as its result is still to be read,
    and no stage removes anything when the first one is called anew."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _left.pop(place - 1, None)
        if before:
            remove_unused(before, docs)
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _left.clear()
        if place < len(_PLAIN) - 1:
            _left[place] = paths
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [(name, _tidy(i, stage)) for i, (name, stage) in enumerate(_PLAIN)]

#: None of the later stages is SQL: signatures, hashes of windows, token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in _PLAIN[:-1]:
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        docs = staged(out, f"stage-{name}")
        remove_unused(paths, docs)  # this run's own, and written by now
    return _PLAIN[-1][1](spark, docs, sf_dir)
