"""Corpus shards (gzip JSON lines): discovery, reading, and the classification of lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The names of the counters.
METRICS = ("lines_seen", "json_documents", "documents_with_text", "malformed_json_lines", "non_object_json_lines", "missing_or_non_string_text", "utf8_replacement_lines", "tokens_seen")
KINDS = ("blank", "malformed", "non_object", "no_text", "text")


def discover_shards(spark: SparkSession, root: str, expected: int | None = None) -> DataFrame:
    """(id, relative_path, size, modified): *.json.gz below root by path, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").load(root)
    base = root.rstrip("/") + "/"
    rows = files.select(F.expr(f"substring_index(path, '{base}', -1)").alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    at = F.row_number().over(Window.orderBy("relative_path"))  # a row per file
    found = rows.select(F.format_string("shard-%04d", at - 1).alias("id"), "relative_path", "size", "modified")
    if expected is not None and (n := found.count()) != expected:
        raise ValueError(f"expected {expected} shards, found {n}")
    return found


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): lines end at \\n only; invalid UTF-8 becomes U+FFFD."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").text(path)
    return lines.select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"))


def classify(lines: DataFrame, exact: bool = True) -> DataFrame:
    """lines with kind (one of KINDS) and text.

    exact follows Python's json (NaN and repeated keys are right, anything after the value is wrong); the fast way stays
    in the JVM and differs in these.
    """
    if not exact:
        v = F.try_parse_json("value")
        kind = (
            F.when(F.col("value").rlike(r"(?U)^\s*\z"), "blank").when(v.isNull(), "malformed")
            .when(~F.schema_of_variant(v).startswith("OBJECT"), "non_object")
            .when(F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")), F.lit("")) != "STRING", "no_text").otherwise("text")
        )
        return lines.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "text", F.try_variant_get(v, "$.text", "string")))

    def one(line: str) -> tuple[str, str | None]:
        if not line.strip():
            return "blank", None
        try:
            found = json.loads(line)
        except (ValueError, RecursionError):
            return "malformed", None
        if not isinstance(found, dict):
            return "non_object", None
        text = found.get("text")
        return ("text", text) if isinstance(text, str) else ("no_text", None)

    names = lines.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [one(v) for v in frame["value"]]
            yield frame.assign(kind=[p[0] for p in pairs], text=[p[1] for p in pairs])[[*names, "kind", "text"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInPandas(run, f"{schema}, kind string, text string")


def metrics(classified: DataFrame, *by: str) -> DataFrame:
    """The counters METRICS (by shard, say)."""
    from kataflow.functions.text import tokens

    is_ = lambda *k: F.count_if(F.col("kind").isin(*k))
    sums = [
        F.count("*").alias(METRICS[0]), is_("non_object", "no_text", "text").alias(METRICS[1]), is_("text").alias(METRICS[2]), is_("malformed").alias(METRICS[3]),
        is_("non_object").alias(METRICS[4]), is_("no_text").alias(METRICS[5]), F.count_if(F.contains("value", F.lit("�"))).alias(METRICS[6]),
        F.coalesce(F.sum(F.when(F.col("kind") == "text", F.size(tokens("text")))), F.lit(0)).cast("long").alias(METRICS[7]),
    ]
    return classified.groupBy(*by).agg(*sums) if by else classified.agg(*sums)
