"""Metadata filters, compiled to one predicate that Catalyst pushes down."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import InvalidDateFormat
from lodestone.functions.text import touches_path


def _day(value: str) -> str:
    try:
        return datetime.strptime(value, "%Y-%m-%d").strftime("%Y-%m-%d")
    except ValueError:
        raise InvalidDateFormat(f"Not a date: {value!r}") from None


@dataclass(frozen=True)
class SearchFilters:
    """All that are given must hold. Dates are days in UTC, both inclusive."""

    author: str | None = None
    after: str | None = None
    before: str | None = None
    file: str | None = None

    def is_active(self) -> bool:
        return any(x is not None for x in (self.author, self.after, self.before, self.file))

    def predicate(self) -> Column:
        """Dates are checked here, before anything runs."""
        found = [F.lit(True)]
        if self.after is not None:
            found.append(F.col("date") >= F.lit(f"{_day(self.after)} 00:00:00").cast("timestamp"))
        if self.before is not None:
            found.append(F.col("date") <= F.lit(f"{_day(self.before)} 23:59:59").cast("timestamp"))
        if self.author is not None:
            found.append(F.contains(F.lower("author"), F.lit(self.author.lower())))
        if self.file is not None:
            found.append(touches_path(F.col("diff_summary"), self.file))
        return reduce(lambda a, b: a & b, found[1:] or found)

    def apply(self, rows: DataFrame) -> DataFrame:
        predicate = self.predicate()
        return rows.where(predicate) if self.is_active() else rows


def candidate_count(rows: DataFrame, filters: SearchFilters) -> DataFrame:
    return filters.apply(rows).agg(F.count(F.lit(1)).alias("candidates"))
