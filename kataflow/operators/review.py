"""Review queues: frequent tokens that aren't headwords, a seed of three groups, and numbered batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST, PER_GROUP, MEDIUM, LONG, BATCH, BATCHES = 100_000, 100, 8, 13, 10_000, 10


def _order() -> list[Column]:
    return [F.desc("occurrences"), F.asc("token")]


def non_headwords(rows: DataFrame, headwords: DataFrame, most: int = MOST) -> DataFrame:
    """The first `most` rows, in order, whose lower-cased token is no headword."""
    words = headwords.select(F.col("headword").alias("_w"))
    return rows.join(words, F.lower("token") == F.col("_w"), "left_anti").orderBy(*_order()).limit(most)


def scan_metrics(rows: DataFrame, headwords: DataFrame, most: int = MOST) -> DataFrame:
    """What a scan in order reads until it has `most` rows: one row (non_headwords, scanned, matched).

    Each row is marked once. The last row kept (one row on the driver) gives the place where the scan ends; the rest is
    one aggregate, without a global window.
    """
    words = headwords.select(F.col("headword").alias("_w"), F.lit(1).alias("_hit"))
    marked = rows.join(words, F.lower("token") == F.col("_w"), "left").select("token", "occurrences", F.col("_hit").isNotNull().alias("hit")).persist()
    low = (-F.col("occurrences")).alias("low")
    end = marked.where(~F.col("hit")).orderBy(*_order()).limit(most).agg(F.count("*").alias("n"), F.max(F.struct(low, "token")).alias("last")).first()
    inside = F.lit(True)
    if end.n == most:
        inside = F.struct(low, "token") <= F.struct(F.lit(end.last.low).alias("low"), F.lit(end.last.token).alias("token"))
    kept = marked.where(inside).agg(F.count_if(~F.col("hit")).alias("non_headword_rows"), F.count("*").alias("scanned_rows"), F.count_if(F.col("hit")).alias("matched_rows"))
    row = kept.first()
    marked.unpersist()
    return rows.sparkSession.createDataFrame([row], kept.schema)


def seed(rows: DataFrame, per_group: int = PER_GROUP, strict: bool = False) -> DataFrame:
    """(group_no, position, token, occurrences): the first rows of all, of medium and of long tokens; groups overlap."""
    groups = [
        rows.where(F.char_length("token") >= n).orderBy(*_order()).limit(per_group)
        .withColumn("position", F.row_number().over(Window.orderBy(*_order()))).select(F.lit(k).alias("group_no"), "position", "token", "occurrences")
        for k, n in enumerate((0, MEDIUM, LONG), 1)
    ]
    found = groups[0].union(groups[1]).union(groups[2])
    if strict and found.count() < 3 * per_group:
        raise ValueError("Not enough non-headword rows to build the review seed")
    return found


def batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, position, token, occurrences): the ordered rows (MOST at most) dealt into batches from 0."""
    at = F.row_number().over(Window.orderBy(*_order()))
    return rows.orderBy(*_order()).limit(MOST).withColumn("position", at).withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int"))


def batch_name(batch: int, size: int = BATCH) -> str:
    return f"corpus-review-{batch * size // 1000}-{(batch + 1) * size // 1000}k.csv"
