"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against the word windows of documents.

Words: A-Z lower-cased, then runs of ASCII letters, digits and all other non-ASCII characters. The windows of an item
are its `width` consecutive words; an item with fewer words (but some) is one window. Documents are scanned whole in
Arrow batches: words become numbers of the benchmark's vocabulary, runs of known words are hashed by position, and each
hit is verified word by word. The broadcast is bounded: a benchmark over BLOCK_CHARS is dealt into blocks that are
broadcast one after another, each pass adding its hits to the (stored) result of the pass before.

Null and empty texts have no words and no hits; a null or empty item has no window; items are known by item_id, and
repeated items count once by id; repeated documents are each scanned. Columns of the input are kept; input columns named
as an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kataflow.llm.common import chunks, durable, mix, tidy

WIDTH, BLOCK_CHARS = 10, 16_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BASE = np.uint64(0x100000001B3)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ADDED = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Windows:
    """The n-grams of a block of items: numbered words, and by window length the sorted hashes, numbers and items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        grams: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            n = min(width, len(ids))
            for k in range(len(ids) - n + 1 if n else 0):
                grams.setdefault(n, {}).setdefault(tuple(ids[k : k + n]), set()).add(item)
        self.by_length = []
        for n, found in grams.items():
            ids = np.array(list(found), np.int64).reshape(-1, n)
            hashes = self.hashes(ids)
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((n, hashes[order], ids[order], [sorted(found[tuple(r)]) for r in ids[order].tolist()]))

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        h = np.zeros(len(ids), np.uint64)
        for k in range(ids.shape[1]):
            h = h * _BASE + mix(ids[:, k].astype(np.uint64))
        return h

    def find(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[list[str]]]]:
        """Positions, length and window numbers of every verified occurrence in a row of word numbers (-1: unknown)."""
        stops = np.flatnonzero(ids < 0)
        ends = np.append(stops, len(ids))[np.searchsorted(stops, np.arange(len(ids)))]
        run = ends - np.arange(len(ids))
        for n, hashes, grams, items in self.by_length:
            at = np.flatnonzero(run >= n)
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * _BASE + mix(ids[at + k].astype(np.uint64))
            first = np.searchsorted(hashes, h)
            while len(at):
                same = (first < len(hashes)) & (hashes[np.minimum(first, len(hashes) - 1)] == h)
                at, h, first = at[same], h[same], first[same]
                ok = (ids[at[:, None] + np.arange(n)] == grams[first]).all(1)
                yield at[ok], n, first[ok], items
                at, h, first = at[~ok], h[~ok], first[~ok] + 1


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _scan_block(docs: DataFrame, items: list[tuple[str, str]], width: int, again: bool, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    old = {"n_words", "hits", "items"}
    fields = [docs.schema[c] for c in keep if c not in old]
    schema = T.StructType(fields + T._parse_datatype_string(ADDED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, width)
        get = windows.vocabulary.get
        for batch, texts in chunks(batches, "text"):
            split = [words(t) for t in texts]
            lengths = np.array([len(w) for w in split], np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
            ids = np.full(int((lengths + 1).sum()), -1, np.int64)
            for s, w in zip(starts.tolist(), split, strict=True):
                ids[s : s + len(w)] = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
            cover = np.zeros(len(ids) + 1, np.int64)
            found: list[set[str]] = [set() for _ in texts]
            for at, n, which, names in windows.find(ids):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n, -1)
                rows = np.searchsorted(starts, at, side="right") - 1
                for r, w in set(zip(rows.tolist(), which.tolist(), strict=True)):
                    found[r].update(names[w])
            hit = np.cumsum(cover)[:-1] > 0
            touched = np.add.reduceat(hit, starts) > 0
            spans: list[list[tuple[int, int]]] = [_intervals(hit[s : s + n]) if t else [] for s, n, t in zip(starts.tolist(), lengths.tolist(), touched.tolist(), strict=True)]
            if again:
                for k, (hits, names) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    found[k].update(names)
                    flags = np.zeros(int(lengths[k]), bool)
                    for a, b in [*spans[k], *((x["start"], x["end"]) for x in hits)]:
                        flags[a:b] = True
                    spans[k] = _intervals(flags)
            out = [pa.array(lengths), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *out], [f.name for f in schema])

    return docs.mapInArrow(tidy(run), schema)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (its columns `keep`, all by default) with n_words, hits (word intervals) and items (ids as sorted strings)."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    total = bench.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    keep = keep or docs.columns
    out = docs
    for k in range(blocks):
        items = [(r.item_id, r.text) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        last = k == blocks - 1
        out = _scan_block(out, items, width, k > 0, keep if last else docs.columns)
        if not last:
            out = durable(out)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, mode: str = "documents") -> DataFrame:
    """docs without its contaminated documents, or (mode "spans") with the hit words cut out of their texts."""
    found = scan(docs, benchmark, width)
    if mode == "documents":
        return found.where(F.size("hits") == 0).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for t, h in zip(texts, hits, strict=True):
            if t is None or not len(h):
                out.append(t)
                continue
            at = [m.span() for m in _WORD.finditer(t)]
            pos, parts = 0, []
            for x in h:
                parts.append(t[pos : at[x["start"]][0]])
                pos = at[x["end"] - 1][1]
            out.append("".join([*parts, t[pos:]]))
        return pd.Series(out)

    return found.withColumn("text", F.when(F.size("hits") > 0, cut("text", "hits")).otherwise(F.col("text"))).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
