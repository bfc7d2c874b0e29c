import gzip
import json

import pytest
from pyspark.sql import functions as F

from kataflow.operators import cases, counts, headwords, resolve, review
from kataflow.plans import runs
from kataflow.sources import corpus, tables
from kataflow.streaming import counts as streaming


def shard(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress("\n".join(lines).encode()))


LINES = ['{"text": "Aku aku kata-kata liputan6"}', '{"text": "aku; Caf\u00e9 Cafe\u0301"}', '{"url": "x"}', "{broken", "", "[1]", '{"text": 1}']


def test_count_and_merge(spark, tmp_path):
    shard(tmp_path / "in/a/one.json.gz", LINES)
    config = runs.Config(str(tmp_path / "in"), str(tmp_path / "out"), 1)
    assert runs.count(spark, config) == 1 and runs.count(spark, config) == 0
    first = runs.merge(spark, config)
    once = (tmp_path / "out/token_frequencies.csv.gz").read_bytes()
    assert runs.merge(spark, config)["output"] == first["output"] and (tmp_path / "out/token_frequencies.csv.gz").read_bytes() == once
    assert gzip.decompress(once).decode().split("\n") == ["token,occurrences", "aku,2", "Aku,1", "Cafe\u0301,1", "Caf\u00e9,1", "kata-kata,1", "liputan6,1", ""]
    assert first["aggregate_metrics"] == {"lines_seen": 7, "json_documents": 5, "documents_with_text": 2, "malformed_json_lines": 1, "non_object_json_lines": 1, "missing_or_non_string_text": 2, "utf8_replacement_lines": 0, "tokens_seen": 7}
    with pytest.raises(ValueError, match="another run"):
        runs.prepare(spark, runs.Config(str(tmp_path / "in"), str(tmp_path / "out"), 1) if shard(tmp_path / "in/a/one.json.gz", LINES[:2]) is None else config)
    with pytest.raises(ValueError, match="expected 3 shards"):
        runs.prepare(spark, runs.Config(str(tmp_path / "in"), str(tmp_path / "out2"), 3))


def test_classify(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, '{"text": "a"} x', '{"text": NaN}', '{"text":"a","text":"b"}', '{"text": "x�"}\r']], "value string")
    exact = [(r.kind, r.text) for r in corpus.classify(df).collect()]
    assert [k for k, _ in exact] == ["text", "text", "no_text", "malformed", "blank", "non_object", "no_text", "malformed", "no_text", "text", "text"]
    assert exact[9][1] == "b"
    fast = [r.kind for r in corpus.classify(df, exact=False).limit(7).collect()]
    assert fast == [k for k, _ in exact][:7]


def test_count_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 2), ('q"x', 1), ("l'amour", 0)], "token string, occurrences long")
    for name in ("x.csv", "x.csv.gz"):
        tables.write_csv(df, str(tmp_path / name))
        assert [tuple(r) for r in tables.read_counts(spark, str(tmp_path / name)).collect()] == [("a,b", 2), ('q"x', 1), ("l'amour", 0)]
    for bad in ("occurrences,token\n1,a\n", "token,occurrences\na,1,2\n", "token,occurrences\na,-1\n", "token,occurrences\na,x\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017, PT011
            tables.read_counts(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "review.csv").write_text("token,occurrences,expected_result,is_interesting\n")
    assert tables.read_review(spark, str(tmp_path / "review.csv")).count() == 0


def test_headwords(spark, tmp_path):
    (tmp_path / "a.txt").write_text("kata\nKata\n\nsama\n")
    (tmp_path / "b.txt").write_text("sama\nbeda\n")
    index = headwords.index(tables.read_headwords(spark, str(tmp_path)))
    assert {r.headword: r.sources for r in index.collect()} == {"kata": ["a.txt"], "Kata": ["a.txt"], "sama": ["a.txt", "b.txt"], "beda": ["b.txt"]}
    tables.write_headwords(index, str(tmp_path / "all"), str(tmp_path / "prov"))
    assert (tmp_path / "all").read_text() == "Kata\nbeda\nkata\nsama\n"
    assert json.loads((tmp_path / "prov").read_text().split("\n")[3]) == {"headword": "sama", "sources": ["a.txt", "b.txt"]}
    (tmp_path / "term_bank_1.json").write_text('[["kata", 1], ["kata"], ["baru", []]]')
    (tmp_path / "term_bank_100.json").write_text('[["no"]]')
    words = tables.read_term_banks(spark, str(tmp_path))
    assert {r[0] for r in words.collect()} == {"kata", "baru"}
    freq = spark.createDataFrame([("kata", 3), ("Kata", 2)], "token string, occurrences long")
    assert [tuple(r) for r in counts.intersect(freq, words).collect()] == [("kata", 3)]
    with pytest.raises(ValueError, match="expected 3"):
        counts.intersect(freq, words, 3)


def test_cleaned(spark):
    df = spark.createDataFrame([("Yang", 60), ("yang", 41), ("123", 900), ("dan", 100), ("K", 101)], "token string, occurrences long")
    assert [tuple(r) for r in counts.ordered(counts.cleaned(df)).collect()] == [("k", 101), ("yang", 101)]


def test_resolution(spark):
    words = spark.createDataFrame([("selesaikan", ["a.txt"]), ("selesai", ["b.txt"])], "headword string, sources array<string>")
    tokens = spark.createDataFrame([("diselesaikan", 123), ("xyz", 4)], "token string, occurrences long")
    from kataflow.operators import candidates as C

    made = C.generate(tokens)
    got = {r.token: r for r in resolve.resolve(tokens, made, words).collect()}
    assert (got["diselesaikan"].resolution, got["diselesaikan"].resolution_rank, got["diselesaikan"].resolution_sources) == ("selesaikan", 3, ["a.txt"])
    assert (got["xyz"].resolution, got["xyz"].resolution_rank, got["xyz"].resolution_sources) == (None, None, [])
    wide = {r.token: r for r in resolve.wide(resolve.resolve(tokens, made, words), made, 3).collect()}
    assert (wide["diselesaikan"].word1, wide["diselesaikan"].word3, wide["xyz"].word2) == ("diselesaikan", "selesaikan", "Xyz" if any(r[2] == "Xyz" for r in C.candidates("xyz")[:2]) else None)
    lines = {r.token: r.line for r in resolve.combined(resolve.traces(tokens.select("token"), made, words)).collect()}
    assert list(lines.items()) == [("xyz", f"xyz {resolve.FATAL}"), ("diselesaikan", "diselesaikan, selesaikan, selesai")]


def test_token_dumps(spark, tmp_path):
    (tmp_path / "one.txt").write_text("beta\n zeta\r\nalpha\nbeta\n\n")
    (tmp_path / "more.TXT").write_text("gamma\nalpha")
    (tmp_path / "x_result.txt").write_text("no")
    found = tables.input_tokens(tables.read_numbered(spark, str(tmp_path)))
    assert sorted((r.file, r.token) for r in found.collect()) == [("more.TXT", "alpha"), ("more.TXT", "gamma"), ("one.txt", "alpha"), ("one.txt", "beta"), ("one.txt", "zeta")]
    assert tables.read_numbered(spark, str(tmp_path / "none")).count() == 0
    once = resolve.first_per(found, ["token"], ["file", "line_no"])
    assert once.where("token = 'alpha'").first().file == "more.TXT"


GOOD = {"a": ("a", [], []), "a, b , c": ("a", ["b", "c"], []), "a, b, (c, d)": ("a", ["b"], ["c", "d"]), "a,(c)": ("a", [], ["c"])}
BAD = {"a, , b": cases.EMPTY, "a, (b), c": cases.NOT_LAST, "a, b, ()": cases.NO_TAIL, "a, ((b))": cases.NESTED, "a, b)": cases.UNMATCHED, "a, (b": cases.OPEN, "a, (b,,c)": cases.EMPTY_TAIL, "a, x(b)": cases.NOT_LAST}


def test_case_grammar(spark):
    df = spark.createDataFrame([(x,) for x in [*GOOD, *BAD, "  "]], "line string")
    rows = {r.line: r for r in cases.parse(df).collect()}
    assert {x: (rows[x].token, rows[x].prefix_hits, rows[x].fuzzy_tail_hits) for x in GOOD} == GOOD and all(rows[x].error is None for x in GOOD)
    assert {x: rows[x].error for x in BAD} == BAD and "  " not in rows
    with pytest.raises(Exception, match="Syntax Error"):
        cases.strict(cases.parse(df)).collect()
    back = cases.parse(df).where("error is null").select(cases.line_of(F.col("token"), F.col("prefix_hits"), F.col("fuzzy_tail_hits")).alias("x"))
    assert {r.x for r in back.collect()} == {"a", "a, b, c", "a, b, (c, d)", "a, (c)"}


def test_case_files_and_evaluation(spark):
    rows = [("1", 1, "a", ["a"], []), ("1", 2, "b", ["x"], ["y"]), ("2", 1, "a", ["a"], []), ("2", 2, "a", ["z"], [])]
    df = spark.createDataFrame(rows, "file string, line_no long, token string, prefix_hits array<string>, fuzzy_tail_hits array<string>")
    once = cases.materialize(df)
    assert sorted((r.file, r.line_no, r.duplicates) for r in once.collect()) == [("1", 1, 1), ("1", 2, 0), ("2", 2, 0)]
    hits = spark.createDataFrame([("a", ["a", "q"]), ("b", ["x", "w"])], "token string, actual array<string>")
    got = {(r.token, r.prefix_hits[0]): (r.passed, r.missing_tail, r.redundant) for r in cases.evaluate(once, hits).collect()}
    assert got == {("a", "a"): (True, [], True), ("b", "x"): (False, ["y"], False), ("a", "z"): (False, [], False)}


def test_review(spark, tmp_path):
    rows = spark.createDataFrame([("YANG", 1000), ("berkata", 900), ("tidakdikenal", 800), ("zzz", 1)], "token string, occurrences long")
    words = spark.createDataFrame([("yang",), ("kata",)], "headword string")
    kept = review.non_headwords(rows, words, 2)
    assert [r.token for r in kept.collect()] == ["berkata", "tidakdikenal"]
    assert tuple(review.scan_metrics(rows, words, 2).first()) == (2, 3, 1) and tuple(review.scan_metrics(rows, words, 9).first()) == (3, 4, 1)
    seed = review.seed(kept, 2)
    assert sorted((r.group_no, r.token) for r in seed.collect()) == [(1, "berkata"), (1, "tidakdikenal"), (2, "tidakdikenal")]
    with pytest.raises(ValueError, match="Not enough"):
        review.seed(kept, 2, strict=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "b/corpus-review-old.csv").write_text("x")
    tables.write_review(kept, seed, str(tmp_path / "seed.csv"), str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir())[:2] == ["corpus-review-0-10k.csv", "corpus-review-10-20k.csv"] and len(list((tmp_path / "b").iterdir())) == 10
    assert (tmp_path / "b/corpus-review-10-20k.csv").read_text() == "token,occurrences,expected_result,is_interesting\n"


def test_shards_of_the_same_name(spark, tmp_path):
    """Shards are known by their path; counts that changed since are refused; a failed batch leaves a record."""
    for folder, text in (("a", "satu satu"), ("b", "dua")):
        shard(tmp_path / f"in/{folder}/one.json.gz", [json.dumps({"text": text})])
    config = runs.Config(str(tmp_path / "in"), str(tmp_path / "out"), 2)
    assert runs.count(spark, config) == 2 and runs.status(spark, config) == {"expected": 2, "done": 2, "failed": []}
    batch = next((tmp_path / "out/ledger").iterdir())
    assert {(r.shard, r.token, r.occurrences) for r in spark.read.parquet(str(batch / "counts")).collect()} == {("a/one.json.gz", "satu", 2), ("b/one.json.gz", "dua", 1)}
    assert runs.merge(spark, config)["output"]["total_occurrences"] == 3
    spark.createDataFrame([("b/one.json.gz", "tiga", 1)], "shard string, token string, occurrences long").write.mode("append").parquet(str(batch / "counts"))
    with pytest.raises(ValueError, match="counts of 1 shards"):
        runs.merge(spark, config)


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from kataflow import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    shard(tmp_path / "in/a.json.gz", [json.dumps({"text": "makan makan minum"})])
    (tmp_path / "run.json").write_text(json.dumps({"corpus_dir": "in", "output_dir": "out", "expected_shards": 1, "workers": 1, "checkpoint_every_lines": 5, "log_every_lines": 5}))
    for command in ("count", "merge", "status"):
        cli.main([command, "--config", str(tmp_path / "run.json")])
    assert '"done": 1' in capsys.readouterr().out
    (tmp_path / "words").mkdir()
    (tmp_path / "words/a.txt").write_text("makan\nbaca\n")
    cli.main(["build-headwords", "--headwords", str(tmp_path / "words"), "--out", str(tmp_path / "out")])
    assert (tmp_path / "out/headwords_combined.txt").read_text() == "baca\nmakan\n"
    (tmp_path / "banks").mkdir()
    (tmp_path / "banks/term_bank_1.json").write_text('[["makan"]]')
    cli.main(["intersect", "--counts", str(tmp_path / "out/token_frequencies.csv.gz"), "--banks", str(tmp_path / "banks"), "--out", str(tmp_path / "out/both.csv"), "--any-size"])
    assert (tmp_path / "out/both.csv").read_text() == "token,occurrences\nmakan,2\n"
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps/x.txt").write_text("dibaca\nqqq\n")
    cli.main(["debug-traces", "--dumps", str(tmp_path / "dumps"), "--headwords", str(tmp_path / "words"), "--out", str(tmp_path / "traces")])
    assert (tmp_path / "traces/x_result.txt").read_text().split("\n")[:2] == [f"qqq {resolve.FATAL}", "dibaca, baca"]
    assert (tmp_path / "traces/_combined_debug.txt").read_text() == (tmp_path / "traces/x_result.txt").read_text()
    import hashlib

    sums = {"a.txt": hashlib.sha256(b"makan\nbaca\n").hexdigest()}
    (tmp_path / "sums.json").write_text(json.dumps(sums))
    cli.main(["verify-files", "--directory", str(tmp_path / "words"), "--sums", str(tmp_path / "sums.json")])
    (tmp_path / "sums.json").write_text(json.dumps({"a.txt": "0", "b.txt": "1"}))
    with pytest.raises(SystemExit):
        cli.main(["verify-files", "--directory", str(tmp_path / "words"), "--sums", str(tmp_path / "sums.json")])
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        tables.read_counts(spark, str(tmp_path / "empty.csv"))


def test_stream_into_a_folder(spark, tmp_path):
    for expected in ({"a": 2, "b": 1}, {"a": 3, "b": 1}):
        spark.createDataFrame([("a b a" if expected["a"] == 2 else "a",)], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = streaming.run_to(streaming.counts(streaming.read_parquet(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
        assert {r.token: r.occurrences for r in spark.read.parquet(made).collect()} == expected


def test_streaming_resumes(spark, tmp_path):
    spark.createDataFrame([("a b a",)], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for expected in ({"a": 2, "b": 1}, {"a": 3, "b": 1}):
        streaming.run_available(streaming.counts(streaming.read_parquet(spark, str(tmp_path / "in"))), "streamed", str(tmp_path / "state"))
        assert {r.token: r.occurrences for r in spark.table("streamed").collect()} == expected
        spark.createDataFrame([("a",)], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
