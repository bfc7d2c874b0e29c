"""Token counts of a growing corpus: a file stream with a checkpoint resumes where it ended, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kataflow.functions.text import tokens


def counts(stream: DataFrame, text: str = "text") -> DataFrame:
    return stream.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("occurrences"))


def windowed(stream: DataFrame, time: str, width: str, late: str, text: str = "text") -> DataFrame:
    """Counts by time window; events later than `late` are left out and old windows closed."""
    found = stream.withWatermark(time, late).select(F.window(time, width).alias("window"), F.explode(tokens(text)).alias("token"))
    return found.groupBy("window", "token").agg(F.count("*").alias("occurrences"))


def run_available(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete") -> StreamingQuery:
    """Runs df over all files there are now into the memory table `name` (on the driver: for small results), then stops."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return query


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> str | None:
    """Runs df over all files there are now into Parquet below path, a folder for each batch that a retry replaces.

    Returns the folder of the last batch there is, which in complete mode is the whole table; None before the first.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number:09d}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    made = sorted(f.getPath().toString() for f in files.listStatus(folder)) if files.exists(folder) else []
    return made[-1] if made else None


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    schema = spark.read.parquet(path).schema
    if not path.rstrip("/").endswith(".parquet"):
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
