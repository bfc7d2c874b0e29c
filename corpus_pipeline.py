"""The training-data pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
rereads as the next stage's docs. All but the last keep the columns of documents.

Null and empty texts score as texts without words do; where they pass, no other stage drops them, and each is packed as its
end id. Rows that repeat in doc_id and text become one in the second stage, as do near duplicates; rows without a doc_id all
stay. Ties are broken by doc_id. An empty table gives an empty table, at every stage. Columns that documents doesn't have
pass through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kataflow.llm import decontamination, jaccard_join, packing, pii, quality
from kataflow.llm.common import durable, table
from kataflow.llm.queries import tokenizer_path

#: What near duplicates are; op7_jaccard has a contract of its own.
NEAR = jaccard_join.Rule(width=5, percent=80)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at quality.KEEP or more; learned from the labels outside the held-out fold."""
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(quality.remainder("doc_id", 4) != 2))
    return quality.score(docs, weights).where(F.col("score") >= quality.KEEP).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates: sets of 5 words at 0.8 or more, over any chain."""
    return jaccard_join.keep_one(docs, NEAR)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    return pii.redact(pii.detect(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a training sequence."""
    return packing.packed_digests(docs, tokenizer_path())


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", uncontaminated), ("pii", without_personal_data), ("packing", packed)]
#: The stages learn, join by hashes and use a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
