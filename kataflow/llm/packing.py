"""Packing by minimum bin slack: token pieces into sequences of at most `capacity` tokens.

A document is cut every `capacity` tokens. What matters of the pieces is only how many there are of each
length, a histogram of at most `capacity` entries however many documents there are. plan() fills one window
after another: the longest length left, then the multiset of lengths that a bitset subset-sum reaches
closest to capacity, read back by walking the bitsets in reverse; each multiset is used as often as the
counts allow, so the number of multisets is bounded too. Pieces find their place by their rank within
their length, counted in buckets so that no length meets in one task.

Null and empty texts are one piece, the end id. Repeated rows are packed each on its own; pieces that tie
in length are ranked by (doc_id, start). An empty table gives no sequences. Of the input only doc_id and
text are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kataflow.llm.common import chunks, durable, tidy

CAPACITY, END_ID = 4096, 2
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Pieces of one length that are ranked together, and buckets of a length at most: beyond that buckets grow instead, so
#: that neither a bucket nor the list of a length's buckets is more than a task can hold.
BUCKET_ROWS, BUCKETS = 500, 1 << 16
#: Units that a worker keeps (some 80 MB), and characters of the texts whose units it looks up at once.
CACHED_WORDS, HELD_CHARS = 400_000, 2_000_000
#: Where the tokenizer's units are known by rule: below this character.
_BELOW = 0x250


def _chars(*kinds: str) -> str:
    """Characters of these kinds, escaped for a class, that composition leaves alone and that lower-case within their range."""
    found = []
    for c in map(chr, range(0x21, _BELOW)):
        low = c.lower()
        if unicodedata.category(c)[0] in kinds and unicodedata.normalize("NFC", c) == c and len(low) == 1 and ord(low) < _BELOW and unicodedata.category(low)[0] in kinds:
            found.append(re.escape(c))
    return "".join(found)


#: Finds what is not plain. Plain texts are cut into the tokenizer's units and looked up: the tokenizer never joins across
#: units, and each character stands for itself or its lower case. All other texts go to the tokenizer whole.
PLAIN = re.compile(f"[^\t\n\r {_chars('L', 'N', 'P', 'S')}]|<\\|")
#: Units of plain texts other than runs of letters, in the syntax of Arrow: set apart by spaces, all units are what spaces part.
_UNIT = "('s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^\\s{L}{N}]+)".format(L=_chars("L"), N=_chars("N"))


class _Words(dict):
    """Units -> bytes of their ids; the tokenizer sees each new unit once."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a unit
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, new: list[str]) -> None:
        ids = self.encode(" ".join(new))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(new):
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.update(zip(new, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))
        else:  # a unit that the tokenizer cuts otherwise
            self.update((u, self.encode(u).tobytes()) for u in new)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. What it needs at once is learned, in place of all that it knew where that is too much."""
        plain = [not PLAIN.search(t) for t in texts]
        spaced = pc.replace_substring_regex(pa.array([t.lower() for t in compress(texts, plain)], pa.large_string()), _UNIT, r" \1 ")
        split = pc.ascii_split_whitespace(spaced)
        coded = split.flatten().dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self) > CACHED_WORDS:
            self.clear()
        self[""] = b""  # before a leading space and after a trailing one
        if new := [u for u in units if u not in self]:
            self.learn(new)
        found = list(map(self.__getitem__, units))
        ids, n = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = coded.indices.to_numpy()
        copies, first = n[at], (np.cumsum(n) - n)[at]
        ends = np.cumsum(copies)
        flat = ids[np.repeat(first - ends + copies, copies) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))]
        parts = (flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return [next(parts) if known else self.encode(t) for t, known in zip(texts, plain, strict=True)]


@lru_cache(1)
def _words(tokenizer_json: str) -> _Words:
    """Kept by the worker from task to task: what it holds is bounded."""
    return _Words(tokenizer_json)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows PIECES: each document's ids (little-endian unsigned 32 bits) and end_id, cut every `capacity` ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(spec)
        for batch, texts in chunks(batches, "text", HELD_CHARS):
            doc_ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, ids in zip(doc_ids, words.texts(texts), strict=True):
                ids, n = np.concatenate((ids, end)), len(ids) + 1
                for start in range(0, n, capacity):
                    part = ids[start : start + capacity]
                    for column, v in zip(out, (doc_id, start, len(part), part.tobytes(), n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def _fill(counts: Counter, target: int) -> Counter:
    """The multiset within counts whose sum is the largest one up to target."""
    mask, reach, trail = (1 << (target + 1)) - 1, 1, []
    for length in sorted((x for x in counts if 0 < x <= target), reverse=True):
        left, k = min(counts[length], target // length), 1
        while left and not reach >> target & 1:
            k = min(k, left)
            trail.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, 2 * k
        if reach >> target & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(trail):
        if not before >> at & 1:
            at -= length * k
            used[length] += k
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """(times, multiset) until no piece is left."""
    counts, out = Counter({k: v for k, v in counts.items() if v}), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = _fill(counts, capacity - longest)
        counts[longest] += 1
        used[longest] += 1
        times = min(counts[x] // n for x, n in used.items())
        out.append((times, used))
        for x, n in used.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
    return out


def _places(patterns: list[tuple[int, Counter]]) -> np.ndarray:
    """Rows length, first rank, copies in a sequence, first sequence, first offset; sorted."""
    rows, taken, sequence = [], Counter(), 0
    for times, used in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, taken[length], used[length], sequence, offset))
            taken[length] += times * used[length]
            offset += length * used[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with doc_id, start and length, all stored: it is read more than once) with sequence_id and offset."""
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = _places(plan(histogram, capacity))
    buckets = F.array(*(F.lit(min(BUCKETS, -(-histogram.get(i, 0) // BUCKET_ROWS)) or 1) for i in range(capacity + 1)))
    salted = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.element_at(buckets, F.col("length").cast("int") + 1)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order: list[Column] = [F.col("doc_id"), F.col("start")]
    ranked = salted.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1).join(firsts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_at")).drop("_bucket", "_at", "_first")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] * (1 << 44) + places[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            row = places[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            nth, copy = np.divmod(rank - row[:, 1], row[:, 2])
            kept = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(row[:, 3] + nth), pa.array(row[:, 4] + copy * length)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence, with the checksum of its ids."""
    parts = durable(pieces(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
