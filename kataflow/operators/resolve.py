"""Candidates met with headwords: first hits, all hits, wide reports, trace lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FATAL = "FATAL ERROR GAK DAPET HIT CUY"  # fixed value


def hits(candidates: DataFrame, headwords: DataFrame) -> DataFrame:
    """The candidates that are headwords, with the headwords' sources."""
    return candidates.join(headwords.select(F.col("headword").alias("text"), "sources"), "text")


def _met(candidates: DataFrame, headwords: DataFrame) -> DataFrame:
    """All candidates, once, with `sources` where they are headwords."""
    return candidates.join(headwords.select(F.col("headword").alias("text"), F.col("sources").alias("sources")), "text", "left")


def _first(h: str = "h") -> list[Column]:
    none = F.array().cast("array<string>")
    return [F.col(f"{h}.text").alias("resolution"), F.col(f"{h}.rank").alias("resolution_rank"), F.coalesce(f"{h}.sources", none).alias("resolution_sources")]


def by_token(candidates: DataFrame, headwords: DataFrame, *carry: str) -> DataFrame:
    """A row per token that has candidates, in one pass over them: carry, the first hit, candidate_count, and words, all by rank."""
    hit = F.min(F.when(F.col("sources").isNotNull(), F.struct("rank", "text", "sources"))).alias("h")
    words = F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("w")
    found = _met(candidates, headwords).groupBy("token").agg(*(F.first(c).alias(c) for c in carry), hit, F.count("*").alias("candidate_count"), words)
    return found.select("token", *carry, *_first(), "candidate_count", F.transform("w", lambda x: x["text"]).alias("words"))


def resolve(tokens: DataFrame, candidates: DataFrame, headwords: DataFrame) -> DataFrame:
    """tokens with resolution, resolution_rank, resolution_sources (of the first hit) and candidate_count."""
    hit = F.min(F.when(F.col("sources").isNotNull(), F.struct("rank", "text", "sources"))).alias("h")
    made = _met(candidates, headwords).groupBy("token").agg(hit, F.count("*").alias("candidate_count"))
    return tokens.join(made, "token", "left").select(*tokens.columns, *_first(), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"))


def wide(resolved: DataFrame, candidates: DataFrame, words: int | None = None) -> DataFrame:
    """A row per token: resolved's columns and word1 to word`words`, candidates by rank; by default as many as any token has."""
    if words is None:
        words = candidates.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    if not words:
        return resolved
    pivot = candidates.where(F.col("rank") <= words).groupBy("token").pivot("rank", list(range(1, words + 1))).agg(F.first("text"))
    named = pivot.select("token", *(F.col(f"`{k}`").alias(f"word{k}") for k in range(1, words + 1)))
    return resolved.join(named, "token", "left")


def _trace(columns: list[str]) -> list[Column | str]:
    texts = F.transform("h", lambda x: x["text"])
    fatal = F.coalesce(F.size("h"), F.lit(0)) == 0
    line = F.when(fatal, F.concat("token", F.lit(f" {FATAL}"))).otherwise(F.array_join(F.array_prepend(texts, F.col("token")), ", "))
    return [*columns, F.coalesce(F.size("h"), F.lit(0)).alias("hit_count"), fatal.alias("is_fatal"), line.alias("line")]


def traces(tokens: DataFrame, candidates: DataFrame, headwords: DataFrame) -> DataFrame:
    """tokens with hit_count, is_fatal and the line of all hits in order."""
    listed = hits(candidates, headwords).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
    return tokens.join(listed, "token", "left").select(*_trace(tokens.columns))


def traces_by_token(candidates: DataFrame, headwords: DataFrame) -> DataFrame:
    """traces() of all tokens that have candidates, in one pass over them."""
    hit = F.when(F.col("sources").isNotNull(), F.struct("rank", "text"))
    return _met(candidates, headwords).groupBy("token").agg(F.array_sort(F.collect_list(hit)).alias("h")).select(*_trace(["token"]))


def first_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def by_source(rows: DataFrame, line: str = "line_no") -> DataFrame:
    """A file's rows: fatal ones first, each part in input order."""
    return rows.orderBy(F.desc("is_fatal"), line)


def combined(rows: DataFrame) -> DataFrame:
    """Rows of all files: fatal ones first, then by the root collation, then by code points."""
    return rows.orderBy(F.desc("is_fatal"), F.collate("token", "UNICODE"), "token")
