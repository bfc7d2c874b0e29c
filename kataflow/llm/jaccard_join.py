"""Similarity join on sets of word n-grams, by vertical partitioning of the n-gram order.

A Rule says how many words an n-gram has and the least Jaccard similarity, t below: 3 words and 0.9 unless told otherwise.

1. One pass hashes each whole text into its set of n-grams. Documents with equal sets are one node from here on (the
   64-bit hash of the sorted set with the set's size; a clash is expected once in 10^9 distinct sets at odds of 1:40).
2. The global n-gram order puts frequent n-grams last. Which are frequent is counted over all documents by lossy counting
   in each task and summed; any total order gives exact results, so the bounded list of HOT n-grams only saves work.
3. Two sets at t share an n-gram among the first n - ceil(t n) + 1 of each. Nodes that share such an n-gram form a
   list. Short lists give their pairs. In a long list every node is compared with the hub (its best connected node);
   links to the hub connect them, and what is left is compared by pairs only where the triangle inequality of the
   Jaccard distance, sizes, positions and the components so far leave it open. So groups of copies cost links, not pairs.
   Pairs whose parity bits (SKETCH_BITS or more) differ more than sets at t can are dropped before anything is fetched.
4. Candidates are verified exactly: the n-gram order is cut into FRAGMENTS, overlaps of each pair are counted in each
   fragment on its own, and the counts are summed per pair.

Null texts and texts without words have empty sets and link with nothing; repeated rows are nodes' members like all
others. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kataflow.llm.common import CACHED_WORDS, chunks, durable, least_of, mix, tidy
from kataflow.llm.components import components

FRAGMENTS, SHORT, SALTS = 8, 8, 256
#: Entries of the list of frequent n-grams (2 MB when broadcast), how many a task counts at once, least counts.
HOT, COUNTING, HOT_IN_TASK, HOT_IN_ALL = 1 << 18, 1 << 20, 4, 24
#: Bits of the filter that says which texts have candidates (4 MB when broadcast).
FILTER_BITS = 1 << 25
#: Least bits of a sketch.
SKETCH_BITS = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOP = np.uint64(1 << 63)


class Rule(NamedTuple):
    """Words of an n-gram, and the least similarity in percent: over 50 (see _near)."""

    width: int = 3
    percent: int = 90

    @property
    def far(self) -> float:
        """The greatest distance of a link."""
        return (100 - self.percent) / 100


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Sets:
    """Texts to sorted sets of 63-bit n-gram hashes."""

    def __init__(self, width: int):
        self.width, self.hash = width, _Hashes()
        self.factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(words))
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            total += h[k : k + len(total)] * self.factor[k]
        return np.unique(mix(total) >> np.uint64(1))


def _sketch(ids: np.ndarray) -> np.ndarray:
    """Parities of the set's members by their low bits: sets that differ in d members differ in d bits at most.

    Longer sets have more bits, a power of two, so that unrelated ones differ in more bits than sets at t may; halves
    of a sketch, combined by XOR, are the sketch with half the bits.
    """
    bits = max(SKETCH_BITS, 1 << (len(ids) // 2).bit_length())
    odd = np.bincount((ids & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _key(ids: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63)


def _signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of documents (doc_id, mark, n, key, sketch) and of frequent n-grams of a task (gram, times), told apart by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, grams, times, waiting, held = Sets(rule.width), np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        names, words = ["doc_id", "mark", "n", "key", "sketch", "gram", "times"], pa.list_(pa.int64())

        def count() -> tuple[np.ndarray, np.ndarray]:
            found, each = np.unique(np.concatenate(waiting), return_counts=True)
            merged, at = np.unique(np.concatenate([grams, found]), return_inverse=True)
            total = np.bincount(at, np.concatenate([times, each])).astype(np.int64)
            if len(merged) > COUNTING:
                keep = total >= max(2, np.partition(total, -COUNTING)[-COUNTING])
                merged, total = merged[keep], total[keep]
            return merged, total

        for batch, texts in chunks(batches, "text"):
            ids = [sets.of(t) for t in texts]
            n = [len(x) for x in ids]
            keys = [_key(x) if len(x) else None for x in ids]
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array([_sketch(x) for x in ids], words), none, none], names)
            waiting += ids
            held += sum(n)
            if held > COUNTING:
                grams, times = count()
                waiting, held = [], 0
        if waiting:
            grams, times = count()
        hot = times >= HOT_IN_TASK
        none = pa.nulls(int(hot.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(int(hot.sum()), words), pa.array(grams[hot].astype(np.int64)), pa.array(times[hot])], names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(tidy(run), "doc_id long, mark long, n long, key long, sketch array<long>, gram long, times long")


class Order:
    """n-gram hashes to places in the global order: by hash, but HOT ones last, the most frequent at the very end."""

    def __init__(self, hot: np.ndarray):
        by = np.argsort(hot)
        self.grams, self.rank = hot[by], by.astype(np.uint64)

    def place(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return ids
        at = np.minimum(np.searchsorted(self.grams, ids), len(self.grams) - 1)
        return np.sort(np.where(self.grams[at] == ids, _TOP + self.rank[at], ids))


def _prefixes(docs: DataFrame, hot: np.ndarray, rule: Rule) -> DataFrame:
    """(place, key, n, pos): the n-grams of each set among which one must be shared."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, order, seen = Sets(rule.width), Order(shared.value), set()
        for _, texts in chunks(batches, "text"):
            places, keys, sizes, width = [], [], [], []
            for t in texts:
                ids = sets.of(t)
                key = _key(ids)
                if not len(ids) or key in seen:
                    continue
                if len(seen) > CACHED_WORDS:  # it only saves work: copies met again are removed by key
                    seen.clear()
                seen.add(key)
                n = len(ids)
                p = n - -(-rule.percent * n // 100) + 1
                places.append(order.place(ids)[:p])
                keys.append(key)
                sizes.append(n)
                width.append(p)
            if places:
                pos = np.concatenate([np.arange(1, p + 1) for p in width])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places).astype(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), width)), pa.array(np.repeat(sizes, width).astype(np.int32)), pa.array(pos.astype(np.int32))], ["place", "key", "n", "pos"])

    return docs.select("text").mapInArrow(tidy(run), "place long, key long, n int, pos int")


def _segments(docs: DataFrame, hot: np.ndarray, wanted: np.ndarray, rule: Rule) -> DataFrame:
    """(key, fragment, ids): the sets of texts whose hash passes the filter, cut at fixed points of the global order."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, wanted))
    cuts = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 63) // (FRAGMENTS - 1)))[: FRAGMENTS - 2]
    cuts = np.append(cuts, _TOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Sets(rule.width), set()
        order, bits = Order(shared.value[0]), shared.value[1]
        for batch, texts in chunks(batches, "text"):
            out: tuple[list, list, list] = ([], [], [])
            for t, mark in zip(texts, batch.column(1).to_pylist(), strict=True):
                bit = mark % FILTER_BITS
                if mark in seen or not bits[bit >> 3] >> (bit & 7) & 1:
                    continue
                if len(seen) > CACHED_WORDS:  # it only saves work: copies met again are removed by key
                    seen.clear()
                seen.add(mark)
                ids = sets.of(t)
                if not len(ids):
                    continue
                key = _key(ids)
                for k, part in enumerate(np.split(places := order.place(ids), np.searchsorted(places, cuts))):
                    for column, v in zip(out, (key, k, part.tobytes()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["key", "fragment", "ids"])

    return docs.select("text", F.xxhash64("text").alias("mark")).mapInArrow(tidy(run), "key long, fragment int, ids binary")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("na"), b.column("nb"), pa.array(n, pa.int64())], ["a", "b", "na", "nb", "common"])


def _verified(docs: DataFrame, nodes: DataFrame, hot: np.ndarray, pairs: DataFrame, rule: Rule) -> DataFrame:
    """pairs (a, b, na, nb) with their Jaccard similarity: partial overlaps by fragment, summed per pair.

    nodes has the hash of one text (mark) of each key: only those texts' sets are made again.
    """
    pairs = durable(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes.select("key", "mark"), "key").select(F.pmod("mark", F.lit(FILTER_BITS)).alias("bit"))
    words = ends.groupBy(F.shiftright("bit", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("v")).toPandas()  # FILTER_BITS / 32 rows at most
    wanted = np.zeros(FILTER_BITS // 32, "<u4")
    wanted[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    cut = durable(_segments(docs, hot, wanted.view(np.uint8), rule).groupBy("key", "fragment").agg(F.first("ids").alias("ids")))
    x = cut.select(F.col("key").alias("a"), "fragment", F.col("ids").alias("x"))
    y = cut.select(F.col("key").alias("b"), "fragment", F.col("ids").alias("y"))
    met = pairs.join(x, "a").join(y, ["b", "fragment"]).where("length(x) > 0 and length(y) > 0")
    counted = met.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(_overlaps), "a long, b long, na int, nb int, common long")
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return durable(summed.select("a", "b", "na", "nb", "common"))


def _near(x: Column, y: Column, na: Column, nb: Column, rule: Rule) -> Column:
    """Whether two sketches allow t: sets at t differ in (na + nb) (1 - t) / (1 + t) members at most.

    Sizes that can reach a t over 0.5 have sketches of the same length, or one of twice the other's.
    """
    n, xor = F.least(F.size(x), F.size(y)), lambda u, v: u.bitwiseXOR(v)
    folded = [F.when(F.size(c) > n, F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), xor)).otherwise(c) for c in (x, y)]
    bits = F.aggregate(F.zip_with(*folded, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, c: s + c)
    return (100 + rule.percent) * bits <= (100 - rule.percent) * (na + nb)


def _close(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """pairs whose sketches allow t."""
    x, y = nodes.select(F.col("key").alias("a"), F.col("sketch").alias("_x")), nodes.select(F.col("key").alias("b"), F.col("sketch").alias("_y"))
    return pairs.join(x, "a").join(y, "b").where(_near(F.col("_x"), F.col("_y"), F.col("na"), F.col("nb"), rule)).select("a", "b", "na", "nb")


def _linked(rule: Rule) -> str:
    return f"100 * common >= {rule.percent} * (na + nb - common)"


def _may(na: Column, nb: Column, rule: Rule) -> Column:
    """Sizes that can reach t."""
    return (100 * na >= rule.percent * nb) & (100 * nb >= rule.percent * na)


def _bound(x: str, y: str, rule: Rule) -> Column:
    """Overlap still possible when the first n-gram in common is this one."""
    c = F.col
    most = 1 + F.least(c(f"{x}.n") - c(f"{x}.pos"), c(f"{y}.n") - c(f"{y}.pos"))
    return (100 + rule.percent) * most >= rule.percent * (c(f"{x}.n") + c(f"{y}.n"))


def _pair(x: str, y: str) -> list[Column]:
    first = F.col(f"{x}.key") < F.col(f"{y}.key")
    at = lambda p, q, c, name: F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(name)
    return [at(x, y, "key", "a"), at(y, x, "key", "b"), at(x, y, "n", "na"), at(y, x, "n", "nb")]


def _distance(members: DataFrame, checked: DataFrame, name: str) -> DataFrame:
    """members (with hub) with their distance to it; null if it wasn't checked."""
    d = checked.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias(name))
    keyed = members.withColumns({"a": F.least("key", "hub"), "b": F.greatest("key", "hub")})
    return keyed.join(d, ["a", "b"], "left").drop("a", "b").withColumn(name, F.when(F.col("key") == F.col("hub"), 0.0).otherwise(F.col(name)))


def _hub_pairs(members: DataFrame, rule: Rule) -> DataFrame:
    most = 1 + F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos"))
    pairs = members.where((F.col("key") != F.col("hub")) & _may(F.col("n"), F.col("hub_n"), rule) & ((100 + rule.percent) * most >= rule.percent * (F.col("n") + F.col("hub_n"))))
    first = F.col("key") < F.col("hub")
    return pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"), F.when(first, F.col("n")).otherwise(F.col("hub_n")).alias("na"), F.when(first, F.col("hub_n")).otherwise(F.col("n")).alias("nb")).distinct()


def links(docs: DataFrame, nodes: DataFrame, hot: np.ndarray, rule: Rule) -> DataFrame:
    """(a, b) of nodes at t or more: enough of them to connect all that any link connects."""
    # One exchange serves the removal of repeated nodes and the counts. Lists of frequent n-grams (their places are negative)
    # are dealt over SALTS tasks, uncounted: they go the way of long lists.
    often = F.col("place") < 0
    dealt = _prefixes(docs, hot, rule).withColumn("salt", F.when(often, F.pmod("key", F.lit(SALTS))).otherwise(0)).repartition("place", "salt")
    rows = dealt.groupBy("place", "salt", "key").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    k = F.when(often, SHORT + 1).otherwise(F.count("*").over(Window.partitionBy("place", "salt")))
    shared = durable(rows.withColumn("k", k).where("k > 1").drop("salt"))
    few = shared.where(F.col("k") <= SHORT)
    short = few.alias("x").join(few.alias("y"), "place").where((F.col("x.key") < F.col("y.key")) & _may(F.col("x.n"), F.col("y.n"), rule) & _bound("x", "y", rule)).select(*_pair("x", "y")).distinct()

    score = shared.groupBy("key").agg((F.count("*") / F.first("n")).alias("score"))
    many = shared.where(F.col("k") > SHORT).join(score, "key")
    hub = many.groupBy("place").agg(F.max(F.struct("score", "key", "n", "pos")).alias("h")).select("place", F.col("h.key").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
    members = durable(many.join(durable(hub), "place"))  # stored, so that the join can split a long list
    checked = _verified(docs, nodes, hot, _close(short.unionByName(_hub_pairs(members, rule)).distinct(), nodes, rule), rule)
    found = durable(checked.where(_linked(rule)).select("a", "b"))

    # What the hub leaves open in its list: pairs with a node that isn't linked to it, of different components so far.
    group = components(found).select(F.col("node").alias("key"), "label")
    last = _distance(members, checked, "d").withColumn("open", F.coalesce(F.col("d") > rule.far + 1e-12, F.lit(True)))
    last = durable(last.join(group, "key", "left").withColumn("label", F.coalesce("label", "key")).join(nodes.select("key", "sketch"), "key").select("place", "key", "n", "pos", "d", "open", "label", "sketch"))
    near = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= rule.far + 1e-9, F.lit(True))
    rest = (
        last.where("open").alias("x").join(last.alias("y"), "place")
        .where((F.col("x.label") != F.col("y.label")) & (~F.col("y.open") | (F.col("x.key") < F.col("y.key"))) & _may(F.col("x.n"), F.col("y.n"), rule) & _bound("x", "y", rule) & near)
        .where(_near(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"), rule))  # part of the join: no pair leaves it that can't link
        .select(*_pair("x", "y")).distinct()
    )
    rest = durable(rest)
    if rest.limit(1).count() == 0:
        return found
    return found.union(_verified(docs, nodes, hot, rest, rule).where(_linked(rule)).select("a", "b"))


def _grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored rows (doc_id, mark, n, key) of documents; (key, label); and (label, least): the smallest (doc_id, mark) of what links reach.

    mark is the hash of a row's text: rows that share a doc_id are told apart by it.
    """
    first = durable(_signatures(docs, rule))
    grams = durable(first.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT_IN_ALL))
    top = grams.where(F.col("times") >= least_of(grams, "times", HOT, HOT_IN_ALL)).toPandas().sort_values(["times", "gram"])  # HOT rows at most
    hot = top["gram"].to_numpy().astype(np.uint64)
    rows = first.where("gram is null").select("doc_id", "mark", "n", "key")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    nodes = durable(first.where("key is not null").groupBy("key").agg(least.alias("least"), F.first("sketch").alias("sketch"), F.min("mark").alias("mark")))
    labels = components(links(docs, nodes.select("key", "sketch", "mark"), hot, rule))
    named = durable(nodes.select("key", "least").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")))
    return rows, named.select("key", "label"), durable(named.groupBy("label").agg(F.min("least").alias("least")))  # stored, so that a join with it can split a large component


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach from each document."""
    rows, labels, least = _grouped(docs, rule)
    of_key = labels.join(least, "label").select("key", F.col("least.doc_id").alias("component_id"))
    return rows.join(of_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each group that links connect: that of the smallest doc_id.

    Documents without words all stay, and so do rows without a doc_id. Rows that share doc_id and text stay once: the one
    whose other columns, as JSON, come first. Other texts of that doc_id are documents of their own.
    """
    rows, _, least = _grouped(docs, rule)
    kept = least.where("least is not null").select("least.*").union(rows.where("key is null and doc_id is not null").select("doc_id", "mark").distinct())
    mark, rest, nth = (x + "_of_" + "_".join(docs.columns) for x in ("mark", "rest", "nth"))  # longer than any column
    # Dealt once, by doc_id: that serves the window and the join.
    dealt = docs.where("doc_id is not null").repartition("doc_id").withColumns({mark: F.xxhash64("text"), rest: F.to_json(F.struct(F.lit(1).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))))})
    first = dealt.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(rest))).where(F.col(nth) == 1)
    once = first.join(kept.toDF("doc_id", mark), ["doc_id", mark], "left_semi")
    return once.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id is null"))
