"""Counting runs: a manifest that keeps runs apart, per-shard counts that are resumed, a merge that can be repeated.

State is a ledger folder per batch of shards, written once by Spark's commit protocol: counts, metrics, and at last the
shards that are done, each with a mark of its counts. A shard whose file (size, time) has changed since is refused, one that
is done is skipped, counts that don't have their mark any more are refused by the merge. A batch that fails leaves a record.
Shards are known by their path below the corpus folder. Scheduling over workers is Spark's.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kataflow.functions import text
from kataflow.functions.text import TOKEN, tokens
from kataflow.operators import counts
from kataflow.sources import corpus, tables

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Config:
    """A run: where the shards are, where results go, and how many shards there must be."""

    corpus_dir: str
    output_dir: str
    expected_shards: int
    workers: int = 1
    checkpoint_every_lines: int = 100_000
    log_every_lines: int = 25_000

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        missing = sorted(set(cls.__dataclass_fields__) - set(raw))
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        base = os.path.dirname(os.path.abspath(path))
        numbers = {k: int(raw[k]) for k in ("expected_shards", "workers", "checkpoint_every_lines", "log_every_lines")}
        if min(numbers.values()) < 1:
            raise ValueError("settings must be positive")
        return cls(os.path.normpath(os.path.join(base, raw["corpus_dir"])), os.path.normpath(os.path.join(base, raw["output_dir"])), **numbers)


def stable_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def identity(config: Config, shards: DataFrame) -> dict:
    """What two runs must share to be one: shards, tokenizer and settings that shape results."""
    sums = shards.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.expr("sum(cast(pmod(xxhash64(relative_path, size, modified), 1000000007) as long))").alias("mark")).first()
    return {"schema_version": SCHEMA_VERSION, "shards": sums.n, "bytes": sums.size, "inventory": sums.mark, "tokenizer": stable_hash(TOKEN), "implementation": stable_hash([inspect.getsource(m) for m in (text, corpus, counts)]), "corpus_dir": config.corpus_dir}


def prepare(spark: SparkSession, config: Config) -> dict:
    """The manifest; an older one in the output folder must be of the same run."""
    shards = corpus.discover_shards(spark, config.corpus_dir, config.expected_shards)
    own, path = identity(config, shards), os.path.join(config.output_dir, "manifest.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
        if old["identity"] != own:
            raise ValueError("the output folder belongs to another run")
        return old
    manifest = {"identity": own, "configuration": asdict(config), "status": "prepared", "created": time.time()}
    tables.write_json(manifest, path)
    return manifest


def count(spark: SparkSession, config: Config) -> int:
    """Counts the shards that aren't done yet, all in one job, into a batch of the ledger; returns how many."""
    prepare(spark, config)
    ledger = os.path.join(config.output_dir, "ledger")
    shards = corpus.discover_shards(spark, config.corpus_dir, config.expected_shards)
    if os.path.isdir(ledger):
        done = spark.read.parquet(f"{ledger}/*/done").withColumnsRenamed({"size": "old_size", "modified": "old_modified"}).drop("id", "entries", "mark")
        changed = shards.join(done, "relative_path").where("size <> old_size or modified <> old_modified").count()
        if changed:
            raise ValueError(f"{changed} shards have changed since they were counted")
        shards = shards.join(done, "relative_path", "left_anti")
    todo = [r.relative_path for r in shards.collect()]  # a name per file
    if not todo:
        return 0
    batch = os.path.join(ledger, f"batch-{time.time_ns()}")
    lines = spark.read.option("lineSep", "\n").text([os.path.join(config.corpus_dir, p) for p in todo])
    base = config.corpus_dir.rstrip("/") + "/"
    rows = corpus.classify(lines.select(F.make_valid_utf8("value").alias("value"), F.substring_index("_metadata.file_path", base, -1).alias("shard")))
    try:
        rows.where("kind = 'text'").select("shard", F.explode(tokens("text")).alias("token")).groupBy("shard", "token").agg(F.count("*").alias("occurrences")).write.parquet(f"{batch}/counts")
        corpus.metrics(rows, "shard").write.parquet(f"{batch}/metrics")
        marked = shards.join(marks(spark.read.parquet(f"{batch}/counts")), F.col("relative_path") == F.col("shard"), "left").drop("shard")
        marked.write.parquet(f"{batch}/done")  # last: a batch without it is not seen
    except Exception as e:
        tables.write_json({"status": "failed", "shards": todo, "error": str(e)[:2000], "at": time.time()}, os.path.join(batch, "failed.json"))
        raise
    return len(todo)


def marks(counted: DataFrame) -> DataFrame:
    """(shard, entries, mark): a checksum of each shard's counts, whatever their order."""
    return counted.groupBy("shard").agg(F.count("*").alias("entries"), F.bit_xor(F.xxhash64("token", "occurrences")).alias("mark"))


def status(spark: SparkSession, config: Config) -> dict:
    """Shards done and expected, and the records of failed batches."""
    ledger = os.path.join(config.output_dir, "ledger")
    failed = []
    for b in sorted(os.listdir(ledger)) if os.path.isdir(ledger) else ():
        if os.path.exists(path := os.path.join(ledger, b, "failed.json")):
            with open(path, encoding="utf-8") as f:
                failed.append(json.load(f))
    done = [b for b in (os.listdir(ledger) if os.path.isdir(ledger) else ()) if os.path.isdir(os.path.join(ledger, b, "done"))]
    return {"expected": config.expected_shards, "done": spark.read.parquet(*(os.path.join(ledger, b, "done") for b in done)).count() if done else 0, "failed": failed}


def merge(spark: SparkSession, config: Config) -> dict:
    """Writes token_frequencies.csv.gz, ordered, from the whole ledger; the same bytes each time."""
    ledger, path = os.path.join(config.output_dir, "ledger"), os.path.join(config.output_dir, "manifest.json")
    done = spark.read.parquet(f"{ledger}/*/done")
    if done.count() != config.expected_shards:
        raise ValueError("not all shards are counted")
    batches = [os.path.join(ledger, b) for b in sorted(os.listdir(ledger)) if os.path.isdir(os.path.join(ledger, b, "done"))]
    counted = spark.read.parquet(*(f"{b}/counts" for b in batches))
    wrong = done.join(marks(counted).select(F.col("shard").alias("relative_path"), F.col("mark").alias("found")), "relative_path", "left").where(~F.col("mark").eqNullSafe(F.col("found"))).count()
    if wrong:
        raise ValueError(f"the counts of {wrong} shards have changed since they were written")
    merged = counts.merge(counted)
    out = os.path.join(config.output_dir, "token_frequencies.csv.gz")
    tables.write_csv(counts.ordered(merged), out)
    sums = spark.read.parquet(*(f"{b}/metrics" for b in batches)).agg(*(F.sum(m).alias(m) for m in corpus.METRICS)).first().asDict()
    total = counts.totals(merged).first()
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    with open(out, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    manifest |= {"status": "complete", "aggregate_metrics": sums, "output": {"file": os.path.basename(out), "sha256": digest, "unique_tokens": total.unique_tokens, "total_occurrences": total.total_occurrences}}
    tables.write_json(manifest, path)
    return manifest
