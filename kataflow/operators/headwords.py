"""The headword index: distinct headwords with the sorted list of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(lines: DataFrame, headword: str = "headword", source: str = "source") -> DataFrame:
    """(headword, sources) from (headword, source) rows; empty headwords are skipped, nothing is trimmed."""
    return lines.where(F.col(headword) != "").groupBy(F.col(headword).alias("headword")).agg(F.array_sort(F.collect_set(source)).alias("sources"))
