import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kataflow.llm import jaccard_join, lm, quality, topk
from kataflow.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").encode().translate(LOW).decode())


def brute(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 3]) for k in range(max(len(w) - 2, min(len(w), 1))))))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted((str(i), len(s), str(least.get(find(x)))) for x, (i, s) in enumerate(sets))


def near_copies(seed, n, edits):
    """Groups of copies with so many words changed, from a base and from each other, among unrelated texts."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(300)]
    for g in range(4):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 150, 2100]))
        rows.append(" ".join(base))
        for _ in range(n):
            t = list(base if rng.random() < 0.7 else rows[-1].split())
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t))
        rows += [" ".join(rng.choices(vocabulary[:20], k=rng.randint(1, 14))) for _ in range(10)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows += [f"{passage} {rng.choice(vocabulary)} {' '.join(rng.choices(vocabulary, k=rng.randint(0, 6)))}" for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_join_is_exact(spark, odd, none):
    for seed, n, edits in ((1, 14, 3), (2, 30, 2)):
        rows = near_copies(seed, n, edits)
        got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = jaccard_join.join(odd).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    kept = jaccard_join.keep_one(odd)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, None], key=str) and kept.columns == odd.columns
    assert jaccard_join.join(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def brute_links(rows, width, percent):
    sets = [(i, frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, min(len(w), 1))))) for i, w in ((i, words(t)) for i, t in rows)]
    label = {i: i for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return [(i, len(s), label[i]) for i, s in sets]


def test_near_duplicate_stage_is_exact(spark):
    import corpus_pipeline

    rows = near_copies(3, 25, 5)
    want, own = brute_links(rows, 5, 80), brute_links(rows, 3, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.join(df, corpus_pipeline.NEAR).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    kept = sorted(i for i, _, least in want if i == least)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == kept and kept != sorted(i for i, _, least in own if i == least)


def test_kept_rows_are_told_apart(spark):
    """Rows that share a doc_id but not the text, repeats that differ in another column, columns named like ours."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a, "y"), (1, a, "x"), (1, b, "z"), (2, b, "z"), (3, a + " more", "x"), (4, None, "x"), (4, None, "x"), (5, "", "x"), (None, a, "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth string").withColumns({"mark": F.lit(1), "key": F.lit("k"), "least": F.lit(2)}).repartition(3)
    kept = jaccard_join.keep_one(df, jaccard_join.Rule(5, 80))
    assert sorted(((r.doc_id, r.text, r._nth) for r in kept.collect()), key=str) == sorted([(1, a, "x"), (1, b, "z"), (4, None, "x"), (5, "", "x"), (None, a, "x"), (None, a, "x")], key=str)
    assert kept.columns == df.columns


def test_frequent_grams_go_last():
    order = jaccard_join.Order(np.array([5, 3], np.uint64))
    assert order.place(np.array([1, 3, 5, 9], np.uint64)).tolist() == [1, 9, (1 << 63) + 0, (1 << 63) + 1]


def test_sketch_never_says_too_much():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 9000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 40, rng.integers(0, 90)).astype(np.uint64)]))
        x, y = jaccard_join._sketch(a), jaccard_join._sketch(b)
        while len(x) != len(y):
            x, y = (z[: len(z) // 2] ^ z[len(z) // 2 :] if len(z) > min(len(x), len(y)) else z for z in (x, y))
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), *((k, k + 1) for k in range(20, 60)), (70, 70)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 70: 70} | dict.fromkeys(range(20, 61), 20)


def test_topk_is_exact(spark, monkeypatch):
    for name, size in (("BLOCK", 64), ("RANGE", 256), ("QUERIES", 8)):  # many ranges and blocks of queries
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 900, 1500), rng.standard_normal((1500, 6)).round(2), strict=True)]
    rows += [(5000, None), (5001, [1.0, None, 2.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6), (5100, [3.0, 1.0]), (5101, []), (None, [1.0]), (700, [0.5] * 6), (700, [0.5] * 6), (5200, [1e9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df.selectExpr("*", "1 as score"), df.where("vec_id % 100 = 0")).collect()
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 100 == 0:
            want += [(i, s, j) for s, j in sorted(((sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i), key=lambda x: (-x[0], x[1]))[:10]]
    assert max(Counter(i for i, _ in ok if i % 100 == 0).values()) > 1  # rows that repeat a query's id are queries too
    assert sorted((r.query_id, r.score, r.vec_id) for r in got) == sorted(want)
    ranks = Counter((r.query_id, r.rank) for r in got)
    assert all(ranks[i, k] == n for i, n in Counter(i for i, _ in ok if i % 100 == 0).items() for k in range(1, 11))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_all_training_text_is_learned_from(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(n)) for n in (0, 3, 700, 128, 40, 1500)]
    gathered = lm.gather(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).where("segment is not null").collect()
    segments = [np.frombuffer(r.segment, np.int64) for r in gathered]
    whole = np.concatenate([h for t in texts for h in (np.fromiter((lm._Hashes()[w] for w in lm.words(t)), np.int64), [lm.END])])
    # Each segment begins with the token that the one before ends with: all but the first token are learned once.
    assert np.concatenate([segments[0], *(s[1:] for s in segments[1:])]).tolist() == whole.tolist()
    assert len(segments[-1]) < lm.SEGMENT + 1
    assert all(a[-1] == b[0] for a, b in zip(segments, segments[1:], strict=False))


def test_short_training_text_trains(spark):
    df = spark.createDataFrame([(k, "a b c d e f g h") for k in range(3)], "doc_id long, text string").coalesce(1)
    v = lm.vocabulary(lm.gather(df).where("word is not null").groupBy("word").agg(F.sum("c").alias("c")))
    segments = lm.gather(df).where("segment is not null").select("segment")
    assert not np.array_equal(lm.train(segments, v, lambda: v), lm.Model.initial(v).flat)


def test_blocks_are_skipped():
    rng = np.random.default_rng(1)
    blocks = [(np.arange(k * 50, k * 50 + 50), (rng.integers(0, 10, (50, 8)) * (100 if k == 3 else 1)).astype(np.int64)) for k in range(20)]
    *_, scored = topk.search(np.array([-1]), np.ones((1, 8), np.int64), blocks, 10)
    assert scored < 5


def test_gradients():
    v = lm.Vocabulary(np.arange(20) * 7 - 3, np.arange(20, 0, -1), 210, 25, 0.3, 9)
    m = lm.Model(lm.Model.initial(v).flat.astype(np.float64))
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.arange(20), [lm.HEAD, lm.HEAD + 3, lm.RARE]])
    x, y = rng.choice(ids, (5, 4)), rng.choice(ids, (5, 4))
    h = rng.standard_normal((4, lm.HIDDEN))

    def loss():
        return -m.logs(m.steps(x, h)[0].reshape(-1, lm.HIDDEN), y.reshape(-1)).mean()

    before, old = m.flat.copy(), lm.Model(np.zeros(lm.Model.SIZE))
    m.learn(x, y, h.copy(), old)
    seen = np.sqrt(old.flat)  # after one update: the size of each gradient
    m.flat[:] = before
    for k in np.argsort(-seen)[:: max(1, int((seen > 0).sum() // 40))][:40]:
        m.flat[k] = before[k] + 1e-3
        up = loss()
        m.flat[k] = before[k] - 1e-3
        down = loss()
        m.flat[k] = before[k]
        assert abs(abs(up - down) / 2e-3 - seen[k]) < 2e-3 * max(1, seen[k]) + 1e-4


def test_trainers_are_added_in_a_tree(spark, monkeypatch):
    """Many trainers, a small fan-in: the result is the mean of what each makes of its share, and all segments are used once."""
    monkeypatch.setattr(lm, "SEGMENTS_PER_TRAINER", 1)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rng = random.Random(4)
    df = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(9)}" for _ in range(40))) for k in range(24)], "doc_id long, text string").repartition(12)
    gathered = lm.gather(df).cache()
    v = lm.vocabulary(gathered.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")))
    segments = gathered.where("segment is not null").select("segment")
    assert segments.count() == 12 and segments.rdd.getNumPartitions() == 12
    made = lm.Model(lm.train(segments, v, lambda: v))
    states = lambda m: m.steps(np.full((3, 1), int(v.end)), np.zeros((1, lm.HIDDEN), np.float32))[0][:, 0]
    ids = v.of(np.fromiter((lm._Hashes()[f"w{k}".encode()] for k in range(9)), np.int64))[0]
    before = lm.Model.initial(v)
    assert np.isfinite(made.flat).all() and not np.array_equal(states(made), states(before)) and (ids < lm.HEAD).all()


def test_probabilities_sum_to_one():
    v = lm.Vocabulary(np.arange(30), np.arange(60, 30, -1), 1500, 40, 0.3, 9)
    m = lm.Model.initial(v)
    h = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    ids = np.concatenate([np.arange(lm.HEAD), np.arange(lm.HEAD, lm.RARE + 1)])
    assert abs(np.exp(m.logs(np.repeat(h, len(ids), 0), ids)).sum() - 1) < 1e-4


def test_all_words_sum_to_one(spark):
    """Head, middle, rare and unseen words: the last are one word of the rare class."""
    texts = [" ".join([f"w{k % 7}" for k in range(60)] + [f"m{k}" for k in range(30)] * 2 + [f"r{k}" for k in range(25)])] * 1
    df = spark.createDataFrame([(0, texts[0])], "doc_id long, text string")
    table = lm.gather(df).where("word is not null").groupBy("word").agg(F.sum("c").alias("c"))
    v = lm.vocabulary(table)
    m, counts = lm.Model.initial(v), {r.word: r.c for r in table.collect()}
    h = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32) * 0.3
    total = 0.0
    for word, c in counts.items():
        ids, at = v.of(np.array([word]))
        share = v.share[at[0]] if at[0] >= 0 else np.log((1 - v.unseen) * c / v.mass[lm.RARE])
        total += np.exp(m.logs(h, ids)[0] + share)
    unseen = np.exp(m.logs(h, np.array([lm.RARE]))[0]) * v.unseen
    own = np.concatenate([np.unique(v.ids), [lm.RARE]]).astype(np.int64)
    reachable = np.exp(m.logs(np.repeat(h, len(own), 0), own)).sum()  # the rest is on head places and powers without words
    assert abs(total + unseen - reachable) < 1e-5 and unseen > 0


def test_windows_carry_the_state():
    v = lm.Vocabulary(np.arange(30), np.arange(60, 30, -1), 1500, 40, 0.3, 9)
    m = lm.Model.initial(v)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 30, n) for n in (1, 70, 33, 200, 32)]
    got = lm.score_ids(m, np.concatenate(texts), np.array([len(t) for t in texts]), 7)
    for t, s in zip(texts, got, strict=True):
        states, _ = m.steps(np.concatenate([[7], t[:-1]])[:, None], np.zeros((1, lm.HIDDEN), np.float32))
        assert abs(m.logs(states[:, 0], t).sum() - s) < 1e-3 * len(t)


def test_words_are_looked_at_in_bulk(monkeypatch):
    """Long texts end in windows with few states: these are put together, over groups of texts, and lose no token."""
    v = lm.Vocabulary(np.arange(30), np.arange(60, 30, -1), 1500, 40, 0.3, 9)
    m = lm.Model.initial(v)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 30, n) for n in (900, 1, 70, 33, 200, 32, 500, 5, 64)]
    alone = [m.logs(m.steps(np.concatenate([[7], t[:-1]])[:, None], np.zeros((1, lm.HIDDEN), np.float32))[0][:, 0], t).sum() for t in texts]
    calls, logs = [], lm.Model.logs
    monkeypatch.setattr(lm.Model, "logs", lambda self, h, y: calls.append(len(y)) or logs(self, h, y))
    for streams, waiting, most in ((256, 32768, 1), (2, 128, 2 * sum(map(len, texts)) // 128 + 1)):
        monkeypatch.setattr(lm, "STREAMS", streams)
        monkeypatch.setattr(lm, "WAITING", waiting)
        calls.clear()
        got = lm.score_ids(m, np.concatenate(texts), np.array([len(t) for t in texts]), 7)
        assert np.abs(got - alone).max() < 1 and sum(calls) == sum(map(len, texts)) and len(calls) <= most
    assert len(lm.score_ids(m, np.empty(0, np.int64), np.empty(0, np.int64), 7)) == 0


def test_windows_are_learned_in_kept_arrays():
    """A second window of the same shape gets the first one's arrays; sums by id are those of adding row by row."""
    v = lm.Vocabulary(np.arange(300), np.arange(600, 300, -1), 150_000, 400, 0.3, 9)
    m = lm.Model(lm.Model.initial(v).flat.astype(np.float64))
    rng = np.random.default_rng(3)
    x, y = (np.minimum(rng.zipf(1.3, (8, 60)), 299) for _ in range(2))
    before, old = m.win.copy(), lm.Model(np.zeros(lm.Model.SIZE))
    h = m.learn(x, y, np.zeros((60, lm.HIDDEN)), old)
    sums = np.zeros_like(m.win)
    np.add.at(sums.reshape(-1, 3, lm.HIDDEN), x.reshape(-1), m.held["da"].reshape(3, -1, lm.HIDDEN).transpose(1, 0, 2))
    assert np.allclose(np.sqrt(old.win), np.abs(sums)) and (np.sign(before - m.win) == np.sign(sums)).all()
    held = {k: id(a) for k, a in m.held.items()}
    m.learn(x, y, h, old)
    assert {k: id(a) for k, a in m.held.items()} == held


def test_lm_scores(spark, odd, none):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["the", "of", "and", "to", f"w{i}", "Zé"], k=rng.randint(0, 90)))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, quality.remainder("doc_id", 5) != 1).collect()}
    tokens = {i: [*words(t), "\n"] for i, t in texts}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, t in tokens.items() if i not in held for w in t)
    n, distinct = sum(c.values()), len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n) and abs(got[i].base_score - base) < 1e-6 * max(1, -base)
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert lm.score(odd, F.lit(True)).count() == 11 and lm.score(odd, F.lit(False)).first().train_tokens == 0 and lm.score(none, F.lit(True)).count() == 0
