"""Small file formats: count tables, review tables, headword lists, term banks, token dumps, case files; and their writers."""

from __future__ import annotations

import gzip
import json
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import IO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kataflow.functions.text import trimmed

COUNT_SCHEMA = "token string, occurrences long"
REVIEW_SCHEMA = "token string, occurrences string, expected_result string, is_interesting string"


def read_csv(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """CSV (gzip by suffix) whose header must be the schema's names in order and whose rows must have its width.

    lines: fields hold no line breaks, so that large files without compression are read by several tasks. An empty file,
    which has no header, is an error.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):  # noqa: SLF001
        if f.isFile() and not f.getLen() and f.getPath().getName()[0] not in "._":
            raise ValueError(f"{f.getPath()} is empty: its header is missing")
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("quote", '"').option("escape", '"').option("multiLine", not lines).option("emptyValue", "").option("nullValue", "\x00").csv(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A count table; a negative count raises when run."""
    rows = read_csv(spark, path, COUNT_SCHEMA, lines=True)
    return rows.withColumn("occurrences", F.when(F.col("occurrences") < 0, F.raise_error(F.concat(F.lit("negative count of "), "token")).cast("long")).otherwise(F.col("occurrences")))


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, REVIEW_SCHEMA)


def read_headwords(spark: SparkSession, directory: str) -> DataFrame:
    """(headword, source): the lines of all *.txt, whole; empty ones are left out by the index."""
    return spark.read.option("pathGlobFilter", "*.txt").text(directory).select(F.col("value").alias("headword"), F.col("_metadata.file_name").alias("source"))


def read_term_banks(spark: SparkSession, directory: str, below: int = 100) -> DataFrame:
    """(headword): the distinct first elements of the entries of term_bank_N.json for N under `below`."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "term_bank_*.json").text(directory)
    n = F.regexp_extract(F.col("_metadata.file_name"), r"^term_bank_([0-9]+)\.json$", 1)
    entries = files.where((n != "") & (n.cast("int") < below)).select(F.explode(F.from_json("value", "array<variant>", {"mode": "FAILFAST"})).alias("e"))
    word = F.try_variant_get("e", "$[0]", "string")
    wrong = F.coalesce(F.schema_of_variant(F.try_variant_get("e", "$[0]", "variant")), F.lit("")) != "STRING"
    return entries.select(F.when(wrong, F.raise_error(F.lit("a term bank entry doesn't start with a string")).cast("string")).otherwise(word).alias("headword")).distinct()


def read_numbered(spark: SparkSession, directory: str, results: bool = False) -> DataFrame:
    """(file, line_no, line) of all *.txt (any case), without *_result.txt unless `results`; a missing folder has none.

    Line numbers are by file in reading order, found without a shuffle of whole files: each file is one row first.
    """
    schema = "file string, line_no long, line string"
    if "://" not in directory and not os.path.isdir(directory):
        return spark.createDataFrame([], schema)
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.[tT][xX][tT]").text(directory).select(F.col("_metadata.file_name").alias("file"), "value")
    if not results:
        files = files.where(~F.lower("file").endswith("_result.txt"))
    return files.select("file", F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("line_no", "line")).select("file", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def input_tokens(lines: DataFrame) -> DataFrame:
    """(file, line_no, token): lines trimmed, empty ones dropped, the first of equal ones in a file kept."""
    t = lines.select("file", "line_no", trimmed("line").alias("token")).where("token <> ''")
    return t.withColumn("_n", F.row_number().over(Window.partitionBy("file", "token").orderBy("line_no"))).where("_n = 1").drop("_n")


@contextmanager
def _replacing(path: str) -> Iterator[IO[bytes]]:
    """A file that takes path's place at the end, or never; .gz without time or name, so reruns are equal byte for byte."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            if path.endswith(".gz"):
                with gzip.GzipFile("", "wb", 6, f, mtime=0) as packed:
                    yield packed
            else:
                yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def _field(v: object) -> str:
    s = "" if v is None else str(v)
    return '"' + s.replace('"', '""') + '"' if re.search('[",\r\n]', s) else s


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with the rows in df's order, replaced at once.

    Rows are written as they arrive, a partition at a time; for tables that one file should not hold there is write_parts().
    """
    with _replacing(path) as f:
        f.write((",".join(df.columns) + "\n").encode())
        for row in df.toLocalIterator(prefetchPartitions=True):
            f.write((",".join(map(_field, row)) + "\n").encode())


def write_parts(df: DataFrame, path: str) -> None:
    """Compressed CSV parts, all or none."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path, compression="gzip")


def write_json(value: object, path: str) -> None:
    with _replacing(path) as f:
        f.write((json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def write_lines(lines: Iterable[str], path: str) -> None:
    with _replacing(path) as f:
        for x in lines:
            f.write(f"{x}\n".encode())


def write_headwords(index: DataFrame, words: str, provenance: str) -> int:
    """The sorted list of headwords, and a JSON object (headword, sources) per line, in one pass; returns how many."""
    n = 0
    with _replacing(words) as f, _replacing(provenance) as g:
        for r in index.orderBy("headword").toLocalIterator(prefetchPartitions=True):
            f.write(f"{r.headword}\n".encode())
            g.write((json.dumps({"headword": r.headword, "sources": list(r.sources)}, ensure_ascii=False, separators=(",", ":")) + "\n").encode())
            n += 1
    return n


def write_review(rows: DataFrame, seed: DataFrame, seed_path: str, directory: str) -> None:
    """The seed and all ten batch files (maybe with a header only); older batch files go first."""
    from kataflow.operators import review

    os.makedirs(directory, exist_ok=True)
    for name in os.listdir(directory):
        if re.fullmatch(r"corpus-review-.*\.csv", name):
            os.unlink(os.path.join(directory, name))
    blank = ["token", "occurrences", F.lit("").alias("expected_result"), F.lit("").alias("is_interesting")]
    write_csv(seed.orderBy("group_no", "position").select(*blank), seed_path)
    dealt = review.batches(rows).cache()
    for k in range(review.BATCHES):
        write_csv(dealt.where(F.col("batch") == k).orderBy("position").select(*blank), os.path.join(directory, review.batch_name(k)))
    dealt.unpersist()


def checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, sha256) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.expr("substring_index(path, '/', -1)").alias("file"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, directory: str, pinned: dict[str, str]) -> list[str]:
    """What differs from the pinned sha256 of files (by path below the directory): one message each."""
    base = directory.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    found = files.select(F.expr(f"substring_index(path, '{base}', -1)").alias("file"), F.sha2("content", 256).alias("sha256")).where(F.col("file").isin(*pinned))
    have = {r.file: r.sha256 for r in found.collect()}  # a row per pinned file
    return [f"{f}: expected {h}, got {have.get(f, 'no file')}" for f, h in sorted(pinned.items()) if have.get(f) != h]
