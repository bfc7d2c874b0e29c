"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kataflow.llm import chat, decontamination, html, jaccard_join, lm, packing, pii, quality, sharding, topk
from kataflow.llm.common import table

CONTROL = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select * from values (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) as v(conv_id, turn, role, text)", {"t": CONTROL})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.render(chat.fold(chat.log_rows(rows))))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality.remainder("doc_id", 5)
    scored = lm.score(table(spark, sf_dir, "documents"), fold != 1)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), jaccard_join.Rule(width=3, percent=90))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html, op2_chat, op3_packing, op4_quality, op5_decontamination, op6_lm, op7_jaccard, op8_topk, op9_sharding, op10_pii)}
_SORTED = "ORDER BY turn, role, text"
_ESCAPED = "length(replace(replace(replace({0}, '\\', '\\\\'), '#', '\\h'), '<', '\\l'))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WHOLE = "list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))"
ORACLES: dict[str, str] = {
    "op2_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')) AS x(conv_id, turn, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' {_SORTED})) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {_SORTED}) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""",
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        n AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
        g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
        o AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
        m AS (SELECT o.doc_id, o.k, o.n, g.item FROM o JOIN g ON g.n = o.n AND g.gram = o.gram),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
        s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id""",
    "op8_topk": f"""
        WITH v AS (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS MATERIALIZED (SELECT *, row_number() OVER () AS nth FROM v WHERE vec_id % 100 = 0),
        s AS (SELECT nth, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM q, v c WHERE c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
