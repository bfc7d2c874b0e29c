"""Token counts, their cleaning, and set operations with dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataflow.functions.text import has_ascii_letter, tokens

LEAST = 100  # cleaned tokens occur more often than this
DICTIONARY_SIZE = 112_647  # fixed value: the expected number of headwords of the dictionary


def tokenize(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, pos, token): every token of every text, pos from 1."""
    return df.select(*keep, F.posexplode(tokens(text)).alias("_p", "token")).select(*keep, (F.col("_p") + 1).alias("pos"), "token")


def count(df: DataFrame, text: str, *by: str) -> DataFrame:
    """(by, token, occurrences): partial counts before the one shuffle."""
    return df.select(*by, F.explode(tokens(text)).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("occurrences"))


def merge(shards: DataFrame) -> DataFrame:
    return shards.groupBy("token").agg(F.sum("occurrences").alias("occurrences"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("unique_tokens"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total_occurrences"))


def cleaned(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Lower-cased and added up, with an ASCII letter, then only tokens above `least`: case variants may pass it together."""
    lower = counts.where(has_ascii_letter("token")).select(F.lower("token").alias("token"), "occurrences")
    return lower.groupBy("token").agg(F.sum("occurrences").alias("occurrences")).where(F.col("occurrences") > least)


def ordered(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("occurrences"), "token")


def intersect(counts: DataFrame, headwords: DataFrame, expected: int | None = None) -> DataFrame:
    """The counts of exact headwords; `expected` guards the dictionary's number of distinct headwords."""
    words = headwords.select(F.col(headwords.columns[0]).alias("token")).distinct()
    if expected is not None and (n := words.count()) != expected:
        raise ValueError(f"expected {expected} clean headwords, found {n}")
    return counts.join(words, "token", "left_semi")
