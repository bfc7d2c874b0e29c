"""Command line: python -m kataflow COMMAND, each a thin wrapper around the library."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kataflow.operators import candidates, cases, counts, headwords, resolve, review
from kataflow.plans import runs
from kataflow.sources import tables


def session() -> SparkSession:
    return SparkSession.builder.appName("kataflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def index_of(spark: SparkSession, directory: str) -> DataFrame:
    return headwords.index(tables.read_headwords(spark, directory))


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    print(f"counted {runs.count(spark, runs.Config.load(a.config))} shards")


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    print(runs.merge(spark, runs.Config.load(a.config))["output"])


def intersect(spark: SparkSession, a: argparse.Namespace) -> None:
    found = counts.intersect(tables.read_counts(spark, a.counts), tables.read_term_banks(spark, a.banks), None if a.any_size else counts.DICTIONARY_SIZE)
    tables.write_csv(counts.ordered(found), a.out)


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prints the shards done and expected, and failures."""
    print(json.dumps(runs.status(spark, runs.Config.load(a.config)), sort_keys=True))


def verify_files(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compares files with the sha256 sums of a JSON object (path: sum); ends with 1 where one differs."""
    with open(a.sums, encoding="utf-8") as f:
        pinned = json.load(f)
    wrong = tables.verify(spark, a.directory, pinned)
    print("\n".join(wrong) or f"verified {len(pinned)} files")
    if wrong:
        raise SystemExit(1)


def build_headwords(spark: SparkSession, a: argparse.Namespace) -> None:
    n = tables.write_headwords(index_of(spark, a.headwords), os.path.join(a.out, "headwords_combined.txt"), os.path.join(a.out, "headword_provenance.jsonl"))
    print(f"wrote {n} headwords")


def prepare_frequencies(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cleans a count table and writes the review seed and batches."""
    cleaned = counts.cleaned(tables.read_counts(spark, a.counts)).cache()
    tables.write_csv(counts.ordered(cleaned), os.path.join(a.out, "cleaned.csv.gz"))
    rows = review.non_headwords(cleaned, index_of(spark, a.headwords)).cache()
    tables.write_review(rows, review.seed(rows, strict=True), os.path.join(a.out, "corpus-review-seed.csv"), os.path.join(a.out, "batches"))
    print(review.scan_metrics(cleaned, index_of(spark, a.headwords)).first().asDict())


def debug_traces(spark: SparkSession, a: argparse.Namespace) -> None:
    """A result file per dump, and the combined one."""
    found = tables.input_tokens(tables.read_numbered(spark, a.dumps)).cache()
    traced = resolve.traces(found, candidates.generate(found), index_of(spark, a.headwords)).cache()
    for r in found.select("file").distinct().orderBy("file").collect():  # a row per dump file
        rows = resolve.by_source(traced.where(traced.file == r.file))
        tables.write_lines((x.line for x in rows.toLocalIterator()), os.path.join(a.out, f"{r.file[:-4]}_result.txt"))
    once = resolve.combined(resolve.first_per(traced, ["token"], ["file", "line_no"]))
    tables.write_lines((x.line for x in once.toLocalIterator()), os.path.join(a.out, "_combined_debug.txt"))
    sums = traced.agg(F.count("*"), F.count_if("is_fatal"), F.coalesce(F.sum("hit_count"), F.lit(0))).first()
    print(f"traced {sums[0]} tokens, {sums[1]} fatal, {sums[2]} hits")


def materialize_cases(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed = cases.strict(cases.parse(tables.read_numbered(spark, a.dumps, results=True)))
    once = cases.materialize(parsed).orderBy("file", "line_no").cache()
    tables.write_lines((r.l for r in once.select(cases.line_of(once.token, once.prefix_hits, once.fuzzy_tail_hits).alias("l")).toLocalIterator()), os.path.join(a.out, "_combined_testcases.txt"))
    kept = once.agg(F.count("*"), F.coalesce(F.sum("duplicates"), F.lit(0))).first()
    print(f"wrote {kept[0]} cases, left out {kept[1]} duplicates")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kataflow", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for run, options in (
        (count, ("config",)), (merge, ("config",)), (status, ("config",)), (verify_files, ("directory", "sums")), (intersect, ("counts", "banks", "out")), (build_headwords, ("headwords", "out")),
        (prepare_frequencies, ("counts", "headwords", "out")), (debug_traces, ("dumps", "headwords", "out")), (materialize_cases, ("dumps", "out")),
    ):
        command = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for o in options:
            command.add_argument(f"--{o}", required=True)
        if run is intersect:
            command.add_argument("--any-size", action="store_true", help="don't demand the dictionary's known size")
        command.set_defaults(run=run)
    args = parser.parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
