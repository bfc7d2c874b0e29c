"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's words are seen in two views: the lower-cased word, and its shape (letters, digits and signs as classes, runs as
one; a word that repeats the one before, or whose pair with the one before came earlier in the text, has a shape of its
own). Unigrams and bigrams of both views are hashed into 2^BITS weights; a feature's value is its share of the words, so
a score is a sparse dot product over the words of the whole text, summed in one pass.

Training reads at most `most` labelled rows, those lowest by the hash of doc_id: a bounded sample of the labels, kept in
the memory of one task. Labels, lang, source and doc_id are never inputs. Null and empty texts have the bias as their
score; repeated rows score alike; null labels are not learned from; without labels every score is that of a zero weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataflow.llm.common import CACHED_WORDS, chunks, durable, mix, tidy

BITS, MOST, EPOCHS, KEEP = 18, 8000, 4, 0.7
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.1, 4.0
_CLASSES = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "0"), (re.compile(r"(.)\1+", re.S), r"\1")]


class Features:
    """Texts to hashed features: one row of indices per view and order, over all words of a chunk of texts."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.ids: dict[str, int] = {}
        self.table = np.empty((1024, 2), np.uint64)

    def _number(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.ids) > CACHED_WORDS:
                self.ids.clear()
            for w in words:
                if w not in self.ids:
                    n = self.ids[w] = len(self.ids)
                    if n == len(self.table):
                        self.table = np.concatenate([self.table, self.table])
                    shape = w
                    for rx, to in _CLASSES:
                        shape = rx.sub(to, shape)
                    self.table[n] = xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest("\0" + shape)
            return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def of(self, text: str) -> np.ndarray:
        """4 x words indices: word, word pair, shape, shape pair (a pair ends at the word)."""
        words = text.split()
        if not words:
            return np.empty((4, 0), np.int64)
        ids = self._number(words)
        word, shape = self.table[ids].T
        before = np.concatenate(([0], word[:-1])).astype(np.uint64)
        pair = mix(before * np.uint64(3) + word)
        first = np.zeros(len(words), bool)
        first[np.unique(pair, return_index=True)[1]] = True
        shape = np.where(word == before, np.uint64(1), np.where(first, shape, np.uint64(2)))
        ahead = np.concatenate(([0], shape[:-1])).astype(np.uint64)
        rows = np.stack([mix(word), pair, mix(shape + np.uint64(7)), mix(ahead * np.uint64(5) + shape + np.uint64(11))])
        return (rows & self.mask).astype(np.int64)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, from (label, indices, values): FTRL-Proximal with a learning rate per coordinate."""
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for y, idx, x in rows:
            idx, x = np.append(idx, size), np.append(x, 1.0)
            at = z[idx]
            root = np.sqrt(n[idx])
            w_i = np.where(np.abs(at) <= L1, 0.0, -(at - np.sign(at) * L1) / ((BETA + root) / ALPHA + L2))
            g = (_sigmoid(w_i @ x) - y) * x
            sigma = (np.sqrt(n[idx] + g * g) - root) / ALPHA
            z[idx] += g - sigma * w_i
            n[idx] += g * g
    hot = np.abs(z) > L1
    w[hot] = -(z[hot] - np.sign(z[hot]) * L1) / ((BETA + np.sqrt(n[hot])) / ALPHA + L2)
    return w.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, bits: int = BITS) -> np.ndarray:
    """Weights from the labelled rows of docs; which rows may be learned from is the caller's choice of labels."""
    chosen = labels.where("quality is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most).select("doc_id", "quality")
    learned = docs.select("doc_id", "text").join(F.broadcast(durable(chosen)), "doc_id")  # at most `most` rows of two numbers

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch, texts in chunks(batches, "text"):
            idx, val = [], []
            for t in texts:
                rows = features.of(t)
                found, times = np.unique(rows, return_counts=True)
                idx.append(found.astype("<i4").tobytes())
                val.append((SCALE * times / max(1, rows.shape[1])).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["doc_id", "y", "idx", "val"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[2], r[3]))
        w = ftrl([(y, np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for _, y, i, v in rows], 1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    rows = learned.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int").alias("y")).mapInArrow(tidy(featured), "doc_id long, y int, idx binary, val binary")
    found = rows.repartition(1).mapInArrow(tidy(fit), "w binary").collect()
    return np.frombuffer(found[0].w, np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with `score`, the odds of quality 1 between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c != "score"]
    bits = int(np.log2(len(weights) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), shared.value.astype(float)
        for batch, texts in chunks(batches, "text"):
            rows = [features.of(t) for t in texts]
            x = [w[-1] + SCALE * w[r].sum() / max(1, r.shape[1]) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([_sigmoid(v) for v in x])], [*kept, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score")
    return docs.select(*kept).mapInArrow(tidy(run), f"{schema}, score double")


def remainder(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learned from the labels outside the held-out fold; a row per document."""
    weights = train(docs, labels.where(remainder("doc_id", 4) != 2))
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
