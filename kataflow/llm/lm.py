"""LM scoring: a gated recurrent language model in numpy with a class-factored softmax.

Tokens: words between ASCII white space, A-Z lower-cased, and one end per text. Counts are taken over all training
tokens, by the 64-bit hash of the word. The HEAD most frequent words have vectors and lie in classes of CLASS words each;
the next up to MIDDLE words seen twice or more form a class per power of two of their count; all others, seen or not,
form the rare class. p(word) = p(class | state) * p(word | class, state), where the second factor is a softmax for head
classes and the share of counts for the others; unseen words are one word of the rare class, with the odds that
Good-Turing gives it. So the probabilities of all words sum to one at every step.

Training is by truncated backpropagation over windows of WINDOW tokens, the state carried through a segment of several.
All of the training text is used, once: a task's running text is cut into segments, what is left at its end is one more,
and ROUNDS share the segments among them. In a round, trainers start from the same weights and sums of squares, each goes
over its share of the round's segments, and both are averaged by tokens, in a tree of bounded fan-in. Scoring runs texts side by side in windows, longest first, and carries each text's state to its end.

Null and empty texts are one end token. Repeated rows are counted and scored each. With no training rows the model is
untrained and all words are unseen. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kataflow.llm.common import chunks, durable, least_of, tidy

HEAD, CLASS, MIDDLE, POWERS, HIDDEN = 4096, 64, 1 << 18, 24, 32
WINDOW, SEGMENT, ROUNDS, STREAMS, RATE, FIRST_SQUARES, BLOCK = 32, 128, 2, 256, 0.08, 1e-12, 4096
EPSILON, START = 1e-12, 0.1
SEGMENTS_PER_TRAINER, PARTS, FAN_IN, SCORED_CHARS = 8192, 16, 16, 8_000_000
CLASSES = HEAD // CLASS + POWERS + 1
WAITING = 4 * WINDOW * STREAMS  # states
RARE = HEAD + POWERS  # model ids: head words, powers of two of middle words, rare
END = xxhash.xxh3_64_intdigest(b"\n") - (1 << 63)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


def gather(docs: DataFrame) -> DataFrame:
    """Rows (word, c): hashes and counts of a task's tokens; and rows (segment): the hashes of its text, segment by segment.

    Segments are SEGMENT + 1 tokens of the running text of a task, ends included, the last token being the next one's first;
    the rest of a task's text is a shorter one.
    """
    none = lambda n, t: pa.nulls(n, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = _Hashes(), [], 0
        rest = np.empty(0, np.int64)
        found, c = np.empty(0, np.int64), np.empty(0, np.int64)

        def count() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([found, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([c, times])).astype(np.int64)

        for _, texts in chunks(batches, "text"):
            row = []
            for t in texts:
                w = words(t)
                row += [np.fromiter(map(hashes.__getitem__, w), np.int64, len(w)), np.full(1, END)]
            flat = np.concatenate(row)
            held.append(flat)
            n += len(flat)
            if n > 4_000_000:
                found, c = count()
                held, n = [], 0
            if len(found) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(c), none(len(found), pa.binary())], ["word", "c", "segment"])
                found, c = found[:0], c[:0]
            flat = np.concatenate([rest, flat])
            full = (len(flat) - 1) // SEGMENT
            parts = [flat[k * SEGMENT : k * SEGMENT + SEGMENT + 1].tobytes() for k in range(full)]
            rest = flat[full * SEGMENT :]
            if parts:
                yield pa.RecordBatch.from_arrays([none(len(parts), pa.int64()), none(len(parts), pa.int64()), pa.array(parts, pa.binary())], ["word", "c", "segment"])
        if held:
            found, c = count()
        if len(rest) > 1:
            yield pa.RecordBatch.from_arrays([none(1, pa.int64()), none(1, pa.int64()), pa.array([rest.tobytes()], pa.binary())], ["word", "c", "segment"])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(c), none(len(found), pa.binary())], ["word", "c", "segment"])

    return docs.select("text").mapInArrow(tidy(run), "word long, c long, segment binary")


class Vocabulary:
    """Sorted hashes of head and middle words with model id, count, and static log of the share within the class."""

    def __init__(self, hashes: np.ndarray, c: np.ndarray, n_tokens: int, n_words: int, unseen: float, rare_tokens: int):
        head = np.arange(len(c)) < HEAD
        ids = np.where(head, np.arange(len(c)), HEAD + np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), POWERS - 1))
        mass = np.bincount(ids, c, RARE + 1)
        share = np.where(head, 0.0, np.log(c / np.maximum(mass[ids], 1)))
        by = np.argsort(hashes)
        self.hashes, self.ids, self.c, self.share = hashes[by], ids[by].astype(np.int32), c[by], share[by]
        mass[RARE] = rare_tokens
        self.mass, self.n_tokens, self.n_words, self.unseen = mass, n_tokens, n_words, unseen
        self.end = int(self.ids[np.searchsorted(self.hashes, END)]) if END in hashes else RARE

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model ids, and places in the vocabulary (-1: rare)."""
        if not len(self.hashes):
            return np.full(len(h), RARE, np.int32), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.ids[at], RARE).astype(np.int32), np.where(known, at, -1)


def vocabulary(table: DataFrame) -> Vocabulary:
    """From stored counts: the words seen so often, twice at least, that they are MIDDLE at most."""
    n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = least_of(table, "c", MIDDLE, 2)
    top = table.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])
    next_up = F.coalesce(F.sum(F.when(F.col("c").between(2, least), F.col("c"))), F.lit(0))
    once, seen = table.agg(F.count_if(F.col("c") == 1), next_up).first()
    # Good-Turing: unseen words have the mass of those seen once, words seen c times that of those seen c + 1 times.
    unseen = (once + 0.5) / (once + seen + 1.0)
    return Vocabulary(top["word"].to_numpy(np.int64), top["c"].to_numpy(np.int64), int(n), int(v), unseen, int(n - top["c"].sum()))


def _large(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether logits from rows of weights could overflow: states lie in (-1, 1), so the weights bound them."""
    return np.abs(w).sum(1) + np.abs(b) > 60


class Model:
    """Weights as one flat float32 vector with named views."""

    SHAPES = {"win": (RARE + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "cw": (HIDDEN, CLASSES), "cb": (CLASSES,), "ow": (HEAD, HIDDEN), "ob": (HEAD,)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, self.held, at = flat, {}, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def initial(cls, v: Vocabulary) -> Model:
        """Random small weights, biases at the logs of the shares: untrained, it is the unigram model."""
        m = cls((np.random.default_rng(1).standard_normal(cls.SIZE) * START).astype(np.float32))
        m.cw *= 0.1
        m.ow *= 0.1
        mass = np.concatenate([v.mass[:HEAD].reshape(-1, CLASS).sum(1), v.mass[HEAD:]])
        m.cb[:] = np.log(np.maximum(mass, 1e-3) / max(1, v.mass.sum()))
        m.ob[:] = np.log(np.maximum(v.mass[:HEAD], 1e-6) / np.maximum(1, np.repeat(mass[: HEAD // CLASS], CLASS)))
        return m

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, which later calls get again: fresh ones of this size cost page faults in each window."""
        n = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, self.flat.dtype)
        return self.held[name][:n].reshape(shape)

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """`win` and `u` gate by gate, negated for both logistic gates, which are 1 / (1 + exp(-x))."""
        sign = np.array([-1, -1, 1], self.flat.dtype)[:, None, None]
        return tuple(np.multiply(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2), sign, order="C") for w in (self.win, self.u))

    def steps(self, x: np.ndarray, h: np.ndarray, keep: bool = False, gates: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
        """States after each row of x (steps x streams), from h; with `keep` also what backpropagation needs.

        The arrays are used again by the next call. `gates` are those of _gates(), for callers that don't change the weights.
        """
        k, (length, n) = HIDDEN, x.shape
        win, u = gates or self._gates()
        states = self._room("states", length + 1, n, k)
        states[0] = h
        opened, gated = self._room("opened", length if keep else 1, 3, n, k), self._room("gated", length if keep else 1, 3, n, k)
        before, few = states[0], n <= 8  # few streams: calls cost more than copies
        asked = np.ascontiguousarray(win.take(x, 1).transpose(1, 0, 2, 3)) if few else x
        with np.errstate(over="ignore"):  # exp(-x) may be infinite: the gate is 0
            for t in range(length):
                a, g, new, at = opened[t * keep], gated[t * keep], states[t + 1], asked[t]
                if few:
                    a[:] = at
                else:
                    for one, w in zip(a, win, strict=True):
                        w.take(at, 0, one, "clip")
                np.matmul(before, u, g)
                zr, z, cand = a[:2], a[0], a[2]
                zr += g[:2]
                np.exp(zr, zr)
                zr += 1
                np.reciprocal(zr, zr)
                np.multiply(a[1], g[2], new)
                cand += new
                np.tanh(cand, cand)
                np.subtract(before, cand, new)
                new *= z
                new += cand
                before = new
        return states[1:], (states[:-1], opened, gated)

    def logs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of p(class) and, for head words, p(word | class): in blocks that stay in the processor's cache."""
        out = np.empty(len(y))
        c = np.where(y < HEAD, y // CLASS, y - (HEAD - HEAD // CLASS)).astype(np.int16)
        for start in range(0, len(y), BLOCK):
            part = slice(start, start + BLOCK)
            out[part] = self._softmax_logs(h[part], self.cw, self.cb, c[part])
        by = np.argsort(c, kind="stable")  # a radix sort
        ends = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=CLASSES)[: HEAD // CLASS])))
        by = by[: ends[-1]]
        states, inside, found = h.take(by, 0), y[by] % CLASS, np.empty(len(by))
        for k in np.flatnonzero(np.diff(ends)):
            part, words = slice(ends[k], ends[k + 1]), slice(k * CLASS, (k + 1) * CLASS)
            found[part] = self._softmax_logs(states[part], self.ow[words].T, self.ob[words], inside[part])
        out[by] += found
        return out

    @staticmethod
    def _softmax_logs(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        logits = h @ w
        logits += b
        if _large(w.T, b).any():  # mostly no maximum is needed
            logits -= logits.max(1)[:, None]
        one = logits.reshape(-1)[np.arange(0, logits.size, len(b)) + at].astype(np.float64)
        np.exp(logits, out=logits)
        return one - np.log(logits @ np.ones(logits.shape[1], logits.dtype))

    def _descend(self, name: str, part: slice | np.ndarray, g: np.ndarray, old: Model) -> None:
        """An AdaGrad step of the rows `part` of a matrix; `old` holds the sums of squares."""
        o = getattr(old, name)
        sums = o[part]
        sums += g * g
        if not isinstance(part, slice):
            o[part] = sums
        root = sums + EPSILON
        np.sqrt(root, out=root)
        np.divide(g, root, out=root)
        root *= RATE
        getattr(self, name)[part] -= root

    def learn(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, old: Model) -> np.ndarray:
        """One AdaGrad update from a window (steps x streams); `old` holds the sums of squares. Returns the last state."""
        k, every = HIDDEN, slice(None)
        win, u = self._gates()
        states, (before, opened, gated) = self.steps(x, h, True, (win, u))
        hv, yv, n = states.reshape(-1, k), y.reshape(-1), y.size
        c = np.where(yv < HEAD, yv // CLASS, yv - HEAD + HEAD // CLASS).astype(np.int16)

        every_one, nth = np.ones(max(n, CLASSES, CLASS), hv.dtype), np.arange(n)

        def off(w: np.ndarray, b: np.ndarray, hv: np.ndarray, at: np.ndarray, large: bool) -> np.ndarray:
            """Softmax less one at the right place, by token."""
            p = np.matmul(hv, w, self._room("off", len(hv), len(b)))
            p += b
            if large:  # as in _softmax_logs
                p -= p.max(1)[:, None]
            np.exp(p, p)
            sums = p @ every_one[: len(b)]
            sums *= n
            np.reciprocal(sums, sums)
            p *= sums[:, None]
            p.reshape(-1)[nth[: len(at)] * len(b) + at] -= p.dtype.type(1 / n)
            return p

        dh, dcw, dcb, large = self._room("dh", n, k), np.zeros_like(self.cw), np.zeros_like(self.cb), _large(self.cw.T, self.cb).any()
        for start in range(0, n, BLOCK):
            part = slice(start, start + BLOCK)
            p = off(self.cw, self.cb, hv[part], c[part], large)
            np.matmul(p, self.cw.T, dh[part])
            dcw += hv[part].T @ p
            dcb += every_one[: len(p)] @ p
        by = np.argsort(c, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=CLASSES)[: HEAD // CLASS])))
        by = by[: ends[-1]]
        sorted_h, inside, back = hv.take(by, 0, self._room("sorted", len(by), k), "clip"), yv[by] % CLASS, self._room("back", len(by), k)
        dow, dob = self._room("dow", HEAD, k), self._room("dob", HEAD)
        dow[:], dob[:], large = 0, 0, _large(self.ow, self.ob).reshape(-1, CLASS).any(1)
        for b in np.flatnonzero(np.diff(ends)):
            part, rows = slice(ends[b], ends[b + 1]), slice(b * CLASS, (b + 1) * CLASS)
            s = off(self.ow[rows].T, self.ob[rows], sorted_h[part], inside[part], large[b])
            np.matmul(s, self.ow[rows], back[part])
            np.matmul(s.T, sorted_h[part], dow[rows])
            np.matmul(every_one[: len(s)], s, dob[rows])
        dh[by] += back
        dh, back, da, dgn = dh.reshape(states.shape), np.zeros(h.shape, hv.dtype), self._room("da", 3, *states.shape), self._room("dgn", *states.shape)
        turned = [np.ascontiguousarray(self.u[:, i * k : (i + 1) * k].T) for i in range(3)]
        d, dn, one, two = self._room("loop", 4, *h.shape)
        for t in reversed(range(len(x))):
            (z, r, cand), gn = opened[t], gated[t, 2]
            dz, dr, dcand, dg = da[0, t], da[1, t], da[2, t], dgn[t]
            np.add(dh[t], back, d)
            np.subtract(1, z, one)
            np.multiply(d, one, dn)
            one *= z
            np.subtract(before[t], cand, dz)
            dz *= d
            dz *= one
            np.multiply(cand, cand, one)
            np.subtract(1, one, one)
            np.multiply(dn, one, dcand)
            np.multiply(dcand, r, dg)
            np.subtract(1, r, one)
            np.multiply(dg, one, dr)
            dr *= gn
            np.multiply(d, z, back)
            for g, w in zip((dz, dr, dg), turned, strict=True):
                np.matmul(g, w, two)
                back += two
        hb = before.reshape(-1, k).T
        du = np.concatenate([hb @ g.reshape(-1, k) for g in (da[0], da[1], dgn)], 1)
        ids = x.reshape(-1)
        by = np.argsort(ids.astype(np.int16), kind="stable")
        first = np.concatenate(([0], np.flatnonzero(np.diff(ids[by])) + 1))
        times = np.diff(np.append(first, n))
        most = np.argsort(-times, kind="stable")
        first, times, da = first[most], times[most], da.reshape(3, n, k)
        # Sums by id: all ids' first rows, then the second ones of those that have one, and so on; few ids have many rows.
        sums, nth_row = da.take(by[first], 1), 1
        while (more := int(np.searchsorted(-times, -nth_row))) > 32:
            sums[:, :more] += da.take(by[first[:more] + nth_row], 1)
            nth_row += 1
        for i in range(more):
            sums[:, i] += every_one[: times[i] - nth_row] @ da.take(by[first[i] + nth_row : first[i] + times[i]], 1)
        dwin = sums.transpose(1, 0, 2).reshape(-1, 3 * k)
        for name, part, g in (("cw", every, dcw), ("cb", every, dcb), ("ow", every, dow), ("ob", every, dob), ("u", every, du), ("win", ids[by[first]], dwin)):
            self._descend(name, part, g, old)
        return states[-1].copy()


def train(segments: DataFrame, v: Vocabulary, share: Callable[[], Vocabulary]) -> np.ndarray:
    """The weights after ROUNDS rounds, which deal the stored segments among them: each is learned from once."""
    both = np.concatenate([Model.initial(v).flat, np.full(Model.SIZE, FIRST_SQUARES, np.float32)])
    n = segments.count()
    if not n:
        return both[: Model.SIZE]
    trainers = max(1, -(-n // (ROUNDS * SEGMENTS_PER_TRAINER)))
    kind = "part int, trainer int, tokens long, w binary"
    for k in range(ROUNDS):
        start = segments.sparkSession.sparkContext.broadcast(both)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own, v = start.value.copy(), share()
            m, old = Model(own[: Model.SIZE]), Model(own[Model.SIZE :])
            waiting, rests, tokens = [], [], 0
            for b in batches:
                for s in b.column(0).to_pylist():
                    (waiting if len(s) == 8 * (SEGMENT + 1) else rests).append(s)
                while len(waiting) >= STREAMS:
                    tokens += _go_over(m, old, v, waiting[:STREAMS])
                    waiting = waiting[STREAMS:]
            if waiting:
                tokens += _go_over(m, old, v, waiting)
            for s in rests:
                tokens += _go_over(m, old, v, [s])
            if not tokens:
                return
            parts = np.array_split(own, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array([tokens] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "trainer", "tokens", "w"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            share = frame["tokens"] / frame["tokens"].sum()
            mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * x for w, x in zip(frame["w"], share, strict=True))
            return pd.DataFrame({"part": frame["part"].iloc[:1], "trainer": frame["trainer"].iloc[:1] // FAN_IN, "tokens": [int(frame["tokens"].sum())], "w": [mean.astype(np.float32).tobytes()]})

        own = segments if ROUNDS == 1 else segments.where(F.pmod(F.xxhash64("segment"), F.lit(ROUNDS)) == k)
        sums, left = own.coalesce(trainers).mapInArrow(tidy(run), kind), trainers
        while True:  # a tree: a task adds FAN_IN slices of models at most, however many trainers there are
            sums = sums.groupBy("part", F.floor(F.col("trainer") / FAN_IN)).applyInPandas(add, kind)
            left = -(-left // FAN_IN)
            if left == 1:
                break
        rows = sorted(sums.collect(), key=lambda r: r.part)  # PARTS pieces of one model
        if rows:
            both = np.concatenate([np.frombuffer(r.w, np.float32) for r in rows])
    return both[: Model.SIZE].copy()


def _go_over(m: Model, old: Model, v: Vocabulary, segments: list[bytes]) -> int:
    hashes = np.stack([np.frombuffer(s, np.int64) for s in segments]).T
    ids = v.of(hashes.reshape(-1))[0].reshape(hashes.shape).astype(np.int64)
    h = np.zeros((ids.shape[1], HIDDEN), np.float32)
    for t in range(0, len(ids) - 1, WINDOW):
        x = ids[t : min(t + WINDOW, len(ids) - 1)]
        h = m.learn(x, ids[t + 1 : t + 1 + len(x)], h, old)
    return (len(ids) - 1) * ids.shape[1]


def score_ids(m: Model, flat: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Natural logs of the texts whose model ids stand one after another in flat."""
    before = np.concatenate(([start], flat[:-1]))
    firsts = np.cumsum(lengths) - lengths
    before[firsts] = start
    by = np.argsort(-lengths, kind="stable")
    total, gates, step = np.zeros(len(lengths)), m._gates(), np.arange(WINDOW)[:, None]  # noqa: SLF001
    # The last windows of long texts hold few states, so words wait until there are many states to look at at once.
    waiting, places, texts, held = np.empty((WAITING, HIDDEN), np.float32), [], [], 0

    def empty() -> None:
        nonlocal held
        if held:
            total[:] += np.bincount(np.concatenate(texts), m.logs(waiting[:held], flat[np.concatenate(places)]), len(total))
        places.clear()
        texts.clear()
        held = 0

    for side in range(0, len(by), STREAMS):
        own = by[side : side + STREAMS]
        size, first = lengths[own], firsts[own]
        h = np.zeros((len(own), HIDDEN), np.float32)
        for t in range(0, int(size[0]), WINDOW):
            n = int(np.searchsorted(-size, -t))
            inside = t + step < size[:n]
            at = np.where(inside, first[:n] + t + step, 0)
            states, _ = m.steps(before[at], h[:n], gates=gates)
            h = states[-1]
            more, stream = at[inside], np.nonzero(inside)[1]
            if held + len(more) > WAITING:
                empty()
            waiting[held : held + len(more)] = states[inside]
            held += len(more)
            places.append(more)
            texts.append(own[stream])
    empty()
    return total


def score(docs: DataFrame, learned: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for all docs, learned from those where `learned`."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    gathered = durable(gather(docs.where(learned)))
    table = durable(gathered.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")))
    v = vocabulary(table)
    shared = spark.sparkContext.broadcast(v)
    weights = spark.sparkContext.broadcast(train(gathered.where("segment is not null").select("segment"), v, lambda: shared.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, hashes = shared.value, Model(weights.value), _Hashes()
        at, made = TaskContext.get().partitionId() << 33, 0
        whole = np.log10(v.n_tokens + 0.5 * (v.n_words + 1))
        for batch, texts in chunks(batches, "text", SCORED_CHARS):
            rows = []
            for t in texts:
                w = words(t)
                row = np.full(len(w) + 1, END)
                row[:-1] = np.fromiter(map(hashes.__getitem__, w), np.int64, len(w))
                rows.append(row)
            lengths = np.array([len(r) for r in rows])
            flat = np.concatenate(rows)
            ids, place = v.of(flat)
            logs = score_ids(m, ids, lengths, v.end)
            known, firsts = place >= 0, np.cumsum(lengths) - lengths
            c, share = (np.append(x, 0)[place] for x in (v.c, v.share))
            n_known = np.add.reduceat(known, firsts)
            logs += np.add.reduceat(np.where(known, share, 0.0), firsts)
            base = np.add.reduceat(np.where(known, np.log10(c + 0.5) - whole, 0.0), firsts)
            rare = [np.unique(flat[a : a + n][~known[a : a + n]], return_counts=True) for a, n in zip(firsts.tolist(), lengths.tolist(), strict=True)]
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at + made, at + made + len(rows))), batch.column(0), pa.array(lengths), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(logs / np.log(10)), pa.array([r[0] for r in rare], kinds), pa.array([r[1] for r in rare], kinds)],
                ["row", "doc_id", "n_tokens", "known", "base", "logs", "rare", "times"],
            )
            made += len(rows)

    parts = durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "row long, doc_id long, n_tokens long, known long, base double, logs double, rare array<long>, times array<long>"))
    left = parts.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("n"))).alias("x")).select("row", "x.word", "x.n")
    # Middle words never ask, so what may answer are the words below the vocabulary's least count, and ties at it.
    found = left.join(table, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = v.n_tokens + 0.5 * (v.n_words + 1)
    seen = F.log10((1 - v.unseen) * F.col("c") / float(max(1, v.mass[RARE])))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / whole)).alias("b"),
        F.sum(F.col("n") * F.when(F.col("c") > 0, seen).otherwise(F.lit(float(np.log10(v.unseen))))).alias("s"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("k")).cast("long").alias("n_known"), F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("logs") + zero("s")).alias("score"),
    )
