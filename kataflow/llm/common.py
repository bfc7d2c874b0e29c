"""What the training-data operators share: durable tables, whole-text batches, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the texts that a worker holds at once (one longer text alone), and words that its caches keep.
HELD_CHARS, CACHED_WORDS = 500_000, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kataflow-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and reread: lineage ends there and lost executors lose nothing.

    The folders of a session lie in one folder of its own, which goes when the session's program ends: results that are
    read lazily may need them until then.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/kataflow-{spark.sparkContext.applicationId}"
    if base not in _OWN:
        _OWN.add(base)
        atexit.register(_remove, spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OWN: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001
    except Exception:  # noqa: BLE001  (the session may have ended before its program)
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, after which the worker gives its free memory back: workers are used again by later stages, whose peaks add up."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return whole


def least_of(counts: DataFrame, column: str, most: int, lowest: int) -> int:
    """The least value, `lowest` or more, that at most `most` rows of the stored counts reach.

    Found by histograms of at most 1024 bins, each cutting the one before: neither the driver nor a task sees the rows.
    """
    c = F.col(column)
    low, high, above = lowest, 1 << 62, 0  # `above` rows lie at high or beyond; those in [low, high) are open
    bins = F.floor(F.log2(c.cast("double")) * 16)
    while True:
        found = counts.where((c >= low) & (c < high)).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r.bin):
            if above + r.n <= most:
                above += r.n
            elif r.low == r.high:
                return r.high + 1  # its ties don't fit
            else:
                low, high = r.low, r.high + 1
                break
        else:
            return lowest
        bins = F.floor((c - low) / max(1, -(-(high - low) // 1024)))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = HELD_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts hold about `most` characters at most (one longer text alone), with null as ''."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        start = total = 0
        for k, t in enumerate(texts):
            if k > start and total + len(t) > most:
                yield batch.slice(start, k - start), texts[start:k]
                start, total = k, 0
            total += len(t)
        if texts:
            yield batch.slice(start), texts[start:]


MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + MIX1
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))
