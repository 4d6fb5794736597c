"""Results as JSON and as text; all of it on at most k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import changed_files, diff_preview, rfc3339, short_hash, subject, trim_end


def result_rows(results: DataFrame) -> DataFrame:
    """rank, hash, author, date, subject, message, files, similarity; files and
    similarity are null where there are none."""
    similarity = F.when(~F.isnan(F.col("similarity").cast("double")), F.col("similarity"))
    return results.select(
        F.col("rank").cast("int").alias("rank"),
        "hash",
        "author",
        rfc3339(F.col("date")).alias("date"),
        subject(F.col("message")).alias("subject"),
        trim_end(F.col("message")).alias("message"),
        changed_files(F.col("diff_summary")).alias("files"),
        similarity.alias("similarity"),
    )


def json_document(results: DataFrame, query: str, mode: str, strategy: str, candidates: int, diversified: bool, took_ms: float) -> DataFrame:
    """One row, one column ``json``. Absent values have no key."""
    ordered = F.array_sort(F.collect_list(F.struct(*result_rows(results).columns)))
    head = [F.lit(query).alias("query"), F.lit(mode).alias("mode"), F.lit(strategy).alias("strategy"), F.lit(candidates).cast("long").alias("candidates"), F.lit(diversified).alias("diversified"), F.lit(took_ms).alias("took_ms")]
    return result_rows(results).agg(ordered.alias("results")).select(F.to_json(F.struct(*head, "results")).alias("json"))


def text_lines(results: DataFrame) -> list[str]:
    rows = results.select(
        "rank", short_hash(F.col("hash")).alias("hash"), "author", F.date_format("date", "yyyy-MM-dd").alias("date"), subject(F.col("message")).alias("subject"), "similarity", diff_preview(F.col("diff_summary")).alias("preview")
    )
    out = []
    for r in rows.orderBy("rank").collect():
        match = "keyword match" if r.similarity is None or r.similarity != r.similarity else f"{r.similarity:.2f} similarity"
        out.append(f"{r['rank']}. {r.hash} {r.subject} ({match})")
        out.append(f"   {r.author}, {r.date}")
        if r.preview:
            out.append(f"   {r.preview}")
        out.append("")
    return out
