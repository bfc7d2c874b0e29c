"""Exact top-k inner products, block at a time.

Vectors become integers floor(1024 x). Candidates are cut into blocks of BLOCK vectors of a range of vec_id, each with
its forward index (the vectors) and its largest and smallest value of every term (component). For a query the sum of the
larger of q * max and q * min over terms bounds every score in a block. Blocks are visited in the order of falling
bounds and scored until the bound is below the query's kth score so far.

A range has RANGE vectors and the maxima of all its blocks, so ranges are bounded like blocks. First each block of
QUERIES queries searches the one range of the highest bounds; that gives most queries a kth score to begin with. Then it
meets only ranges whose bound reaches the kth score of one of its queries, and searches them from there. The maxima of
ranges are compared in bounded pieces (PIECE bytes, broadcast). The best of all ranges are merged by a ranking.

Each row of queries is a query of its own: rows that repeat a vec_id have their k rows each. Vectors that are null or
hold null or non-finite components take no part; shorter vectors count as padded with zeros; rows of the query's own
vec_id are no candidates; other repeated rows are candidates each; ties go to the smaller vec_id. No vectors or no
queries give no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kataflow.llm.common import durable, tidy

BLOCK, RANGE, QUERIES, PIECE = 512, 8192, 1024, 32_000_000
OUT = "ask long, row int, query_id long, vec_id long, score long"


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 1024)).alias("v"))


def _blocks(rows: DataFrame, size: int, per_range: int) -> DataFrame:
    """Rows of (range, block, n, dim, ids, matrix, high, low) with up to `size` vectors, by ranges of vec_id."""
    n = rows.count()
    names = ["range", "block", "n", "dim", "ids", "matrix", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made, ids, vecs = TaskContext.get().partitionId(), 0, [], []

        def out() -> pa.RecordBatch:
            dim = max(map(len, vecs))
            m = np.zeros((len(vecs), dim), "<i8")
            for k, v in enumerate(vecs):
                m[k, : len(v)] = v
            numbers = [pa.array([x]) for x in ((at << 32) + made // max(1, per_range // size), (at << 32) + made, len(ids), dim)]
            return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, "<i8"), m, m.max(0), m.min(0)))], names)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                vecs.append(v)
                if len(ids) == size:
                    yield out()
                    made, ids, vecs = made + 1, [], []
        if ids:
            yield out()

    # Rows that share a vec_id may lie in several partitions.
    parts = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // per_range)), "vec_id", "_row").sortWithinPartitions("vec_id", "_row").drop("_row")
    return parts.mapInArrow(tidy(run), "range long, block long, n long, dim long, ids binary, matrix binary, high binary, low binary")


def _padded(m: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def _matrix(r: pd.Series | dict, dim: int) -> np.ndarray:
    return _padded(np.frombuffer(r["matrix"], "<i8").reshape(r["n"], r["dim"]), dim)


def _kind(q: np.ndarray, arrays: list[np.ndarray]) -> type:
    """A type that holds all inner products of q exactly."""
    reach = max([1, *(max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in arrays)]) * max(1, int(q.max(initial=0)), -int(q.min(initial=0))) * max(1, q.shape[1])
    return np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def search(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, kth: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, vec_id, score) of the best k of each query, and how many (query, block) pairs were scored.

    kth: a score that k others reach already, or None; lower scores are left out.
    """
    kind = _kind(q, [m for _, m in blocks])
    q = q.astype(kind)
    high, low = (np.stack([f(m, axis=0) for _, m in blocks]).astype(kind) for f in (np.max, np.min))
    bounds = _bounds(q, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)
    known = kth or [None] * len(q)
    full, scored = np.array([x is not None for x in known], bool), 0
    least = np.array([x or 0 for x in known], kind)
    for step in range(len(blocks)):
        at = order[:, step]
        live = ~full | (bounds[np.arange(len(q)), at] >= least)
        if not live.any():
            break
        new = [(rows, ids, scores)]
        for b in np.unique(at[live]):
            mine = np.flatnonzero(live & (at == b))
            s = q[mine] @ blocks[b][1].astype(kind).T
            keep = (~full[mine, None] | (s >= least[mine, None])) & (blocks[b][0][None, :] != q_ids[mine, None])
            r, c = np.nonzero(keep)
            new.append((mine[r], blocks[b][0][c], s[r, c]))
            scored += len(mine)
        rows, ids, scores = (np.concatenate(x) for x in zip(*new, strict=True))
        by = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[by], ids[by], scores[by]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < k
        rows, ids, scores, rank = rows[kept], ids[kept], scores[kept], rank[kept]
        last = rank == k - 1
        least[rows[last]] = np.where(full[rows[last]], np.maximum(least[rows[last]], scores[last]), scores[last])
        full[rows[last]] = True
    return rows, ids, scores, scored


def _maxima(blocks: DataFrame) -> DataFrame:
    """(range, dim, high, low) over the blocks of each range."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].max())
        high, low = (np.stack([_padded(np.frombuffer(x, "<i8")[None], dim)[0] for x in frame[c]]) for c in ("high", "low"))
        # Where one block is shorter its vectors count as zero there: padding with zeros covers that.
        return pd.DataFrame({"range": frame["range"].iloc[:1], "dim": [dim], "high": [high.max(0).tobytes()], "low": [low.min(0).tobytes()]})

    return blocks.select("range", "dim", "high", "low").groupBy("range").applyInPandas(of, "range long, dim long, high binary, low binary")


def _reached(asked: DataFrame, maxima: DataFrame, first: bool) -> DataFrame:
    """(ask, range, bound): of each block of queries the range of the highest bounds, or all that reach a kth score.

    asked has `kth`, a list with a score or null for each query, unless `first`.
    """
    n, dim = maxima.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    pieces, spark = max(1, -(-n * 16 * dim // PIECE)), asked.sparkSession
    found = None
    for p in range(pieces):
        piece = maxima.where(F.pmod(F.xxhash64("range"), F.lit(pieces)) == p).collect()  # about PIECE bytes
        shared = spark.sparkContext.broadcast([(r["range"], r.dim, bytes(r.high), bytes(r.low)) for r in piece])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            rows = shared.value
            for b in batches:
                out: list[tuple] = []
                for r in b.to_pylist() if rows else ():
                    dim = max(r["dim"], *(x[1] for x in rows))
                    q = _matrix(r, dim)
                    high, low = (np.stack([_padded(np.frombuffer(x[c], "<i8")[None], dim)[0] for x in rows]) for c in (2, 3))
                    kind = _kind(q, [high, low])
                    bounds = _bounds(q.astype(kind), high.astype(kind), low.astype(kind))
                    if first:
                        sums = bounds.sum(0)
                        best = int(np.argmax(sums))
                        out.append((r["ask"], rows[best][0], float(sums[best])))
                    else:
                        least = np.array([0 if x is None else x for x in r["kth"]], kind)
                        open_ = np.array([x is None for x in r["kth"]], bool)
                        out += [(r["ask"], rows[j][0], 0.0) for j in np.flatnonzero((open_[:, None] | (bounds >= least[:, None])).any(0))]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["ask", "range", "bound"])

        made = asked.mapInArrow(tidy(run), "ask long, range long, bound double")
        found = made if found is None else found.unionByName(made)
    if first and pieces > 1:
        found = found.groupBy("ask").agg(F.max_by("range", F.struct("bound", "range")).alias("range"), F.max("bound").alias("bound"))
    return found.select("ask", "range")


def _scored(blocks: DataFrame, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Rows OUT: the best k of every pair (ask, range)."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c.split()[0]: [] for c in OUT.split(", ")}, dtype="int64")
        dim, ask = int(max(left["dim"].max(), right["dim"].max())), right.iloc[0]
        q_ids = np.frombuffer(ask["ids"], "<i8")
        known = None if ask["kth"] is None else [None if x is None or x != x else int(x) for x in ask["kth"]]
        rows, ids, scores, _ = search(q_ids, _matrix(ask, dim), [(np.frombuffer(r["ids"], "<i8"), _matrix(r, dim)) for _, r in left.sort_values("block").iterrows()], k, known)
        return pd.DataFrame({"ask": np.full(len(rows), ask["ask"]), "row": rows, "query_id": q_ids[rows], "vec_id": ids, "score": scores.astype(np.int64)})

    left = blocks.drop("high", "low").join(pairs, "range")
    right = asked.join(pairs.toDF("ask", "range"), "ask")
    return left.groupBy("range", "ask").cogroup(right.groupBy("range", "ask")).applyInPandas(best, OUT)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the best k rows of vectors."""
    blocks = durable(_blocks(whole(vectors), BLOCK, RANGE))
    asked = durable(_blocks(whole(queries), QUERIES, QUERIES)).drop("range", "high", "low").withColumnRenamed("block", "ask")
    maxima = durable(_maxima(blocks))
    none = asked.withColumn("kth", F.lit(None).cast("array<long>"))
    seeds = durable(_reached(none, maxima, True))
    found = durable(_scored(blocks, none, seeds, k))
    kth = found.groupBy("ask", "row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    listed = kth.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("row", "least"))).alias("kth_of"))  # QUERIES entries at most
    row = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    ready = durable(asked.join(listed, "ask", "left").withColumn("kth", F.transform(row, lambda i: F.col("kth_of")[i])).drop("kth_of"))
    pairs = durable(_reached(ready, maxima, False).join(seeds, ["ask", "range"], "left_anti"))
    every = found.unionByName(_scored(blocks, ready, pairs, k))
    rank = F.row_number().over(Window.partitionBy("ask", "row").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
