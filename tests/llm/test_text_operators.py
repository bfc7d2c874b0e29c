import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kataflow.llm import decontamination, packing, pii, quality, sharding
from kataflow.llm.common import least_of
from kataflow.llm.queries import tokenizer_path


def brute_pii(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            if k == "card":
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
                if not 16 <= len(d) <= 19 or sum(v - 9 if v > 9 else v for v in twice) % 10:
                    continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


PII = [
    "a@b.com_x@y.zz é@x.y 1.2.3.4.5.6.7.8 999.1.1.1 007.1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111-1 +1 (017) 555-7713 +12345678901234567 +1 2",
    "x@a" + ".a" * 20_000 + " " + "1 " * 30_000 + "9" * 50_000, "🙂 m@x.co 🙂🙂 m@x.co", "m@x.co " * 1500, "+1-2-3-4-5-6-7-8-", "", None, "1.2.3.4@5.6.7.8 +1.2.3.4.5.6.7.8", "a..b@c..d a@b-.c 12345678901234567890",
]


def test_pii(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(pii.detect(df)).collect()}
    for k, t in enumerate(PII):
        assert found[k].base_sha256 == hashlib.sha256(brute_pii(t or "").encode()).hexdigest(), k
    assert found[4].n_email == 1500 and found[1].n_card == 1


def test_pii_validators_context_and_redaction(spark, odd, none):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 now", "pay to GB83 WEST 1234 5698 7654 32 now", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "04dbebab91ab85687d33eeaaf9ac699e1188f962", "ssn 123-45-6789", "123-45-6789", "mail a@b.cd, 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[(x.kind, texts[r.doc_id][x.start : x.end] == x.text) for x in r.pii] for r in pii.detect(df).orderBy("doc_id").collect()]
    assert got == [[("iban", True)], [], [("secret", True)], [], [("ssn", True)], [], [("email", True), ("ip", True)]]
    assert pii.redact(pii.detect(df)).where("doc_id = 6").first().text == "mail [EMAIL], [IP]"
    many = spark.createDataFrame([(1, "\ufeff🙂 a@b.cd 1.2.3.4@x.yz é" * 2000 + "🙂")], "doc_id long, text string")  # an ip within an email
    assert pii.redact(pii.detect(many)).first().text == "\ufeff🙂 [EMAIL] [IP] é" * 2000 + "🙂"
    assert pii.redact(pii.detect(odd)).select("text").orderBy("doc_id").collect() == odd.select("text").orderBy("doc_id").collect()
    assert pii.detect(none).count() == 0


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.packed_digests(odd, tokenizer_path()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for r in odd.select("doc_id", "text").distinct().collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[r.doc_id], key=lambda x: x.start)
        times = 2 if r.doc_id == 2 else 1
        assert sum(x.length for x in parts) == len(ids) * times
        for x in parts:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) and x.doc_tokens == len(ids)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(places) == list(range(len(places)))
    assert packing.packed_digests(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["it's o'clock don't 'll''s -'s x'RE 12½³ ª«»¿ ÀÉÿž Ǆ ß", "!!!'s 's", "a<|endoftext|>b", "Ω İx ﬁ", "", "\x1fa\x0bb", "The the THE, (the)"])
def test_words_are_the_tokenizers(text):
    with open(tokenizer_path(), encoding="utf-8") as f:
        words = packing._Words(f.read())
    from tokenizers import Tokenizer

    assert words.texts([text])[0].tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_shortcut_gives_the_tokenizers_ids():
    """Every character below U+0250 alone and next to others, random strings, and other scripts among them."""
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    words, tok, rng = packing._Words(spec), Tokenizer.from_str(spec), random.Random(2)
    low = [chr(c) for c in range(0x250)]
    wide = [*low, *"ƏΣσςİ߿अ한中ﬁ🙂\u0301\u200d\u1e9e"]
    texts = [*low, *(a + b for a in low for b in rng.sample(low, 12)), "aƏb", "MƏ» x", "İI ıi"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for alphabet in (low, wide, low[0x180:]) for _ in range(4000)]
    expected = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [t for t, found, ids in zip(texts, words.texts(texts), expected, strict=True) if found.tolist() != ids] == []
    assert [t for t, ids in zip(texts, expected, strict=True) if words.texts([t])[0].tolist() != ids] == []
    assert words.texts([]) == []
    assert sum(not packing.PLAIN.search(t) for t in texts) > 6000


def test_units_that_the_tokenizer_cuts_otherwise(monkeypatch):
    with open(tokenizer_path(), encoding="utf-8") as f:
        words = packing._Words(f.read())
    monkeypatch.setattr(packing, "_UNIT", "([^ ]{2})")
    assert len(words.texts(["it's 12 o'clock"])[0]) > 0  # neither raises nor shifts ids from one unit to the next
    assert words["it"] == words.encode("it").tobytes() and words["12"] == words.encode("12").tobytes()


def test_plan_fills():
    counts = {4096: 3, 3000: 2, 1096: 1, 1095: 1, 1: 4, 700: 9}
    plan = packing.plan(dict(counts))
    used = defaultdict(int)
    for times, multiset in plan:
        assert sum(k * n for k, n in multiset.items()) <= 4096
        for k, n in multiset.items():
            used[k] += times * n
    assert used == counts and (1, {3000: 1, 1096: 1}) in [(t, dict(m)) for t, m in plan]
    # The fill is the best there is: against all subsets.
    from itertools import product

    left = packing.Counter({7: 2, 5: 1, 11: 3, 2: 1})
    for target in range(40):
        best = max(s for c in product(range(3), range(2), range(4), range(2)) if (s := 7 * c[0] + 5 * c[1] + 11 * c[2] + 2 * c[3]) <= target)
        assert sum(k * n for k, n in packing._fill(left, target).items()) == best


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_decontamination(spark, odd, none):
    items = [(1, "one two three four five six seven eight nine TEN eleven"), (2, "short ITEM"), (3, None), (4, ""), (10, "five six seven eight nine ten eleven twelve é ß"), (2, "short ITEM")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "zero one two three four five six seven eight nine ten, eleven end"), (2, "a short-item here"), (3, "clean text"), (4, None), (5, "one two three four five six seven eight nine one two three four five six seven eight nine ten eleven twelve é ß x")]
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chars in (1 << 20, 12):
        got = {r.doc_id: r for r in decontamination.digest(decontamination.scan(df, bench, block_chars=chars)).collect()}
        for i, t in docs:
            w, hit, found = WORD.findall(lower(t or "")), set(), set()
            for g, names in wins.items():
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit.update(range(k, k + len(g)))
                        found |= names
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == {3, 4}
    cut = {r.doc_id: r.text for r in decontamination.clean(df, bench, mode="spans").collect()}
    assert cut[1] == "zero  end" and cut[2] == "a  here" and cut[3] == "clean text"
    assert decontamination.scan(odd, bench).count() == 11 and decontamination.scan(none, bench).count() == 0 and decontamination.clean(odd, bench.limit(0)).count() == 11
    assert decontamination.clean(odd, bench).columns == odd.columns


def test_sharding(spark, odd, none):
    rows = sharding.shard(odd).collect()
    assert len(rows) == 11 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(16))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, 0)} and sharding.shard(none).count() == 0
    # A group of copies that holds a third of all rows is subdivided; the rest of a text's copies stay together.
    many = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('copy ', 20) else repeat(concat('t', cast(id div 2 as string)), 1 + cast(id % 50 as int)) end as text")
    found = sharding.shard(many, 16, 256).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= found["size"].max() and len(found) == 6000 and found["doc_id"].is_unique
    assert sharding.shard(many, 16, 256).toPandas().sort_values("doc_id")["slot"].tolist() == found.sort_values("doc_id")["slot"].tolist()


def test_equal_texts_stay_together(spark):
    # Against a plan made by hand: groups of copies of all sizes, one of them over a shard's due.
    rng = random.Random(7)
    rows, i = [], 0
    for g, n in enumerate([1] * 300 + [2, 3, 5, 8, 13, 40] * 4 + [700]):
        text = f"text {g} " + "x" * (20 if n == 700 else rng.randint(1, 60))
        for _ in range(n):
            rows.append((i, text if g else None))
            i += 1
    rng.shuffle(rows)
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, 128).toPandas().set_index("doc_id")
    of, due = {}, 0
    for d, t in rows:
        of.setdefault(t, []).append(d)
        size = len((t or "").encode()) + 1
        due += size / 8
        assert (found.at[d, "size"], found.at[d, "text_crc32"], found.at[d, "law"]) == (size, zlib.crc32((t or "").encode()), "bytes")
    for t, ids in of.items():
        if len(ids) * found.at[ids[0], "size"] <= due / 4:
            assert found.loc[ids, "shard"].nunique() == 1, t
    loads = found.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() - loads.min() <= max(found["size"].max(), 0.02 * due)
    for _, slots in found.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize(("values", "most", "want"), [([5, 5, 4, 4, 3, 2, 1], 4, 4), ([5, 5, 4, 4, 3, 2, 1], 3, 5), ([5, 5, 4], 1, 6), ([7, 3], 9, 2), ([], 3, 2), ([10**12 + k for k in range(50)], 10, 10**12 + 40)])
def test_least_of(spark, values, most, want):
    assert least_of(spark.createDataFrame([(v,) for v in values], "c long"), "c", most, 2) == want


def test_quality(spark, odd, none):
    good, bad = "The {} of the and in then there {} is it.", "The{}*** of$$$ and%%% {}### in&&& is***"
    texts = [(i, (bad if i % 5 == 0 else good).format(f"w{i}", f"v{i % 7}") * 3) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = quality.digest(df, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == int(r.doc_id % 5 != 0) == int(r.score >= 0.7) for r in held)
    odd_out = quality.digest(odd, labels).collect()
    assert len(odd_out) == 11 and all(0 <= r.score <= 1 for r in odd_out) and len({r.score for r in odd_out if r.doc_id in (3, 4, 5)}) == 1
    assert quality.digest(none, labels).count() == 0 and quality.digest(odd, labels.limit(0)).first().score == 0.5
    assert quality.score(odd, np.zeros(257, np.float32)).columns == [*(c for c in odd.columns if c != "score"), "score"]
    flipped = labels.withColumn("quality", F.when(quality.remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.digest(df, flipped).collect())) == sorted(map(tuple, out))  # held-out labels are not looked at
