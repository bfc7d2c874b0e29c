"""Sharding (native) by sampled splitters under the law `bytes`: sizes near equal, equal texts together.

The key of a row is the hash of its text, so equal texts lie in one range. A sample of keys, drawn with odds in
proportion to size, gives splitters at its quantiles: RANGES key ranges of about equal bytes. Exact bytes of each range
are then summed over all rows; a range over twice its due is subdivided by key. A text whose copies alone are more than
a range's due is a unit of its own, counted in buckets by the hash of doc_id. Units, a bounded number, go to the least
loaded shard, heaviest first. A text's copies stay together in one shard as long as they hold at most a share of a
shard's due bytes; that share is the largest of 1, 1/2, 1/4 and so on down to 1/FINE that leaves the shards within NEAR
of their due (or one row) of each other. Slots are a bucket's first slot plus the rank within it, so neither a shard nor
a group of copies meets in one task.

Null texts have no bytes and size 1; they and empty texts are one group. Repeated rows are sharded each on its own, ties
in rank are between equal rows. An empty table gives no rows. Only doc_id and text are read. Only the sample and the sums
of the units reach the driver, both bounded by RANGES.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from kataflow.llm.common import durable

SHARDS, RANGES, PER_RANGE, CELL_BITS = 16, 4096, 8, 12
#: Buckets of a text's copies hold about 1/FINE of a shard's due; shards are near equal within NEAR of it.
FINE, NEAR = 64, 0.01
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))


def splitters(rows: DataFrame, total: int, ranges: int = RANGES) -> list[int]:
    """Sorted distinct keys that cut the rows into ranges of about equal size."""
    odds = F.least(F.lit(1.0), F.col("size") * (PER_RANGE * ranges / max(total, 1)))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "key"), F.lit(1 << 30)) / float(1 << 30)
    # A row drawn stands for its size, or for the sample's step where it is less; the expected number is PER_RANGE * ranges.
    sample = sorted((r.key, r.w) for r in rows.where(drawn < odds).select("key", F.greatest(F.col("size").cast("double"), F.lit(total / (PER_RANGE * ranges))).alias("w")).collect())
    whole, seen, cuts = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        if seen and seen >= whole * (len(cuts) + 1) / ranges and (not cuts or key > cuts[-1]):
            cuts.append(key)
        seen += w
    return cuts


def _ranged(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """rows with `range`: a hash join on the key's leading bits, then a comparison; the broadcast side has RANGES + 2^CELL_BITS rows at most."""
    shift = 64 - CELL_BITS
    edges = [LOWEST, *cuts]
    bounds = [(c, k, lo, hi) for k, (lo, hi) in enumerate(zip(edges, [*(x - 1 for x in cuts), HIGHEST], strict=True)) for c in range(lo >> shift, (hi >> shift) + 1)]
    table = rows.sparkSession.createDataFrame(bounds, "cell long, range int, lo long, hi long")
    found = rows.withColumn("cell", F.shiftright("key", shift)).join(F.broadcast(table), "cell")
    return found.where("key between lo and hi").drop("cell", "lo", "hi")


def assign(units: list[Row], shards: int, largest: int) -> list[tuple[int, int, int, int, int, int]]:
    """(range, hot, part, bucket, shard, first slot) of each unit (range, hot, part, bucket, size, n)."""
    due = sum(u.size for u in units) / shards
    copies: dict[int, int] = {}
    for u in units:
        copies[u.hot] = copies.get(u.hot, 0) + u.size
    share = 1.0
    while True:
        together: dict[tuple, list[Row]] = {}
        for u in units:
            whole = u.hot < 0 or copies[u.hot] <= share * due
            together.setdefault((u.range, u.hot, u.part, None if whole else u.bucket), []).append(u)
        sized = sorted(((sum(u.size for u in g), name, g) for name, g in together.items()), key=lambda x: (-x[0], *(-1 if v is None else v for v in x[1])))
        loads, homes = [(0, s) for s in range(shards)], []
        for size, _, g in sized:
            load, s = heapq.heappop(loads)
            homes.append((s, g))
            heapq.heappush(loads, (load + size, s))
        if max(loads)[0] - min(loads)[0] <= max(NEAR * due, largest) or share * FINE <= 1:
            break
        share /= 2
    taken, placed = [0] * shards, []
    for s, g in homes:
        for u in g:
            placed.append((u.range, u.hot, u.part, u.bucket, s, taken[s]))
            taken[s] += u.n
    return placed


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per document."""
    rows = durable(sized(docs))
    spark = rows.sparkSession
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranged = _ranged(rows, splitters(rows, total, ranges))
    due = max(1.0, total / ranges)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()
    parts = spark.createDataFrame([(r.range, int(-(-r.size // due)) if r.size > 2 * due else 1) for r in sums], "range int, parts long")
    # Copies over a range's due: fewer than RANGES texts, as their bytes add up; looked for in overfull ranges only.
    over = ranged.join(F.broadcast(parts.where("parts > 1")), "range", "left_semi").groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    step = max(1.0, total / (shards * FINE))
    hot = spark.createDataFrame([(r.key, k, max(1, min(r.n, int(-(-r.size // step))))) for k, r in enumerate(over.where(F.col("size") > due).orderBy("key").collect())], "key long, hot int, buckets long")
    split = ranged.join(F.broadcast(parts), "range").join(F.broadcast(hot), "key", "left")
    split = split.withColumns({
        "part": F.when(F.col("hot").isNull(), F.pmod(F.xxhash64(F.lit("part"), "key"), "parts")).otherwise(0).cast("int"),
        "bucket": F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(F.lit("bucket"), "doc_id"), "buckets")).otherwise(0).cast("int"),
        "hot": F.coalesce("hot", F.lit(-1)),
    }).drop("parts", "buckets")
    unit = ["range", "hot", "part", "bucket"]
    units = split.groupBy(*unit).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # 3 * RANGES + shards * FINE at most
    homes = spark.createDataFrame(assign(units, shards, largest), "range int, hot int, part int, bucket int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy("doc_id", "key", "size")) - 1
    return (
        split.withColumn("rank", rank).join(F.broadcast(homes), unit)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
