import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_stages(spark):
    import corpus_pipeline
    from kataflow.llm.common import durable, table

    docs = table(spark, SMALL, "documents")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = durable(stage(spark, docs, SMALL))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns and docs.count() <= left
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and (name == "pii" or all(before[i] == t for i, t in after.items()))
        if name == "pii":
            assert set(after) == set(before) and any(before[i] != t for i, t in after.items())
        left = docs.count()


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and long texts, ties, repeats and clashing columns through all stages; and an empty table."""
    import corpus_pipeline
    from kataflow.llm.common import durable

    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        made = durable(stage(spark, docs, SMALL))
        none = stage(spark, docs.limit(0), SMALL)
        assert none.count() == 0 and none.columns == made.columns
        if name != "packing":
            assert made.columns == odd.columns
        if name == "quality":
            assert made.count() <= docs.count()
            made = odd  # all rows go on, whatever their quality
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in made.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, None]))
        docs = made


def test_whole_pipeline_against_its_parts(spark):
    """run() against brute force over the documents that the quality stage keeps."""
    import re
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline
    from kataflow.llm import pii
    from kataflow.llm.common import durable, table
    from kataflow.llm.queries import tokenizer_path

    word = re.compile("[^\x20\x09-\x0d]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    kept = durable(corpus_pipeline.good_quality(spark, table(spark, SMALL, "documents"), SMALL))
    docs = {r.doc_id: r.text or "" for r in kept.collect()}
    sets = {}
    for i, t in docs.items():
        w = word.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
    label = {i: i for i in docs}
    order = sorted(docs)
    for x, i in enumerate(order):
        for j in order[:x]:
            if sets[i] and sets[j] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    term = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for r in table(spark, SMALL, "benchmark").collect():
        w = term.findall(lower(r.text))
        n = min(10, len(w))
        windows.setdefault(n, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0))
    left = []
    for i in order:
        w = term.findall(lower(docs[i]))
        if label[i] == i and not any(tuple(w[k : k + n]) in found for n, found in windows.items() if n for k in range(len(w) - n + 1)):
            left.append(i)
    masked = {r.doc_id: r.text for r in pii.redact(pii.detect(spark.createDataFrame([(i, docs[i]) for i in left], "doc_id long, text string"))).collect()}
    tok, want = Tokenizer.from_file(tokenizer_path()), set()
    for i in left:
        ids = [*tok.encode(masked[i], add_special_tokens=False).ids, 2]
        want |= {(i, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
