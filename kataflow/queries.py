"""The registered queries over the reference's capabilities, with the SQL that must agree with each.

The tables hold no headword lists, so headwords are derived from the documents themselves: lower-cased tokens of at
least three documents, with the documents' languages as sources.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kataflow.functions import rules
from kataflow.functions.text import tokens, without_diacritics
from kataflow.operators import candidates, cases, counts, headwords, resolve, review
from kataflow.sources import corpus, tables
from kataflow.streaming import counts as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The token pattern for engines without possessive repetition, inside a quoted string.
RX = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:[''ʼ‐‑’-][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(_read(spark, sf_dir, "documents"), "text")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.cleaned(_frequency(spark, sf_dir))


def _headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("headword"))
    many = found.groupBy("headword").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("lang")).alias("sources"))
    return many.where("n >= 3").select("headword", "sources")


#: Words for the rules: the tables' prose is invented, and some rules would never meet a word of theirs.
WORDS = (
    "bukulah rumahkah siapapun temanku kakakmu ibunya apalah adakah adapun suaraku matamu kotanya "
    "orang2 anak-2 macam2 teman2 kura2 hati-2 gara2 dibacain dibeliin ditulis dipukul dikasihin dilihat disapu ditanyain "
    "ngebangunin nyariin nyuciin ngambilin nungguin nyobain mukulin bacain meriksain ngebut nyari nyuci ngambil nunggu ncari mukul mbaca nge-cek "
    "perbaikan perbaiki bacakan tulisi sapukan ambilkan kirimi lemparkan dapatkan beliin bikinin kasihin cobain tungguin ketabrak kebaca kepukul kelihat ketidakpastian ketulis "
    "ga gak enggak nggak kalo taun cape capek menjijikkan temen semen pemen kemenangan "
    "berlari-lari terbata-bata seolah-olah kehijau-hijauan rumah-rumah makan-makan lari-larian kaubaca kutulis nggakmau gaktahu gamau kaulihat kuambil "
    "memperbaiki mengebom menyapu menyuci menyanyi mengambil mengirim menulis menari menduga memukul membaca memakan merasa melihat menjadi mengecat "
    "pengebom penyapu penyuci penyanyi pengambil pengirim penulis penari penduga pemukul pembaca pemakan perasa pelihat penjaga pengecat "
    "belajar bekerja beras perasa terasa bermain percaya tertawa kebaikan berjatuhan perjalanan ketidakadilan kemauan perbuatan berpelukan dimakan sebuah kedua ketidakmau "
    "tulisan makanan bacai akhirkan harapan"
)
_WORDS_SQL = ", ".join(f"('{w}')" for w in dict.fromkeys(WORDS.split()))


def _lower_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(w,) for w in dict.fromkeys(WORDS.split())], "token string")
    return _frequency(spark, sf_dir).select(F.lower("token").alias("token")).unionByName(own).distinct()


F_CTE = f"f AS (SELECT token, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(text, '{RX}')) AS token FROM documents) GROUP BY token)"
C_CTE = F_CTE + ", c AS (SELECT lower(token) AS token, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM f WHERE regexp_matches(lower(token), '[a-z]') GROUP BY 1 HAVING sum(occurrences) > 100)"
H_CTE = f"h AS (SELECT headword, string_agg(DISTINCT lang, '|' ORDER BY lang) AS sources FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '{RX}'))) AS headword FROM documents) GROUP BY headword HAVING count(*) >= 3)"
T_CTE = F_CTE + f", t AS MATERIALIZED (SELECT lower(token) AS token FROM f UNION SELECT * FROM (VALUES {_WORDS_SQL}) AS x(token))"


# Tokens and counts.


@query(f"SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{RX}') AS t FROM documents)")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.tokenize(_read(spark, sf_dir, "documents"), "text", "doc_id").withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {F_CTE} SELECT token, occurrences FROM f")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.ordered(_frequency(spark, sf_dir))


@query(f"SELECT source, token, count(*) AS occurrences FROM (SELECT source, unnest(regexp_extract_all(text, '{RX}')) AS token FROM documents) GROUP BY ALL")
def token_frequency_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(_read(spark, sf_dir, "documents"), "text", "source")


@query(f"WITH {F_CTE} SELECT count(*) AS unique_tokens, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS total_occurrences FROM f")
def shard_merge_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.totals(counts.merge(token_frequency_by_shard(spark, sf_dir)))


@query(f"SELECT token, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(html, '{RX}')) AS token FROM pages) GROUP BY token")
def html_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(_read(spark, sf_dir, "pages"), "html")


@query(f"SELECT role, token, count(*) AS occurrences FROM (SELECT role, unnest(regexp_extract_all(text, '{RX}')) AS token FROM conversations) GROUP BY ALL")
def conversation_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(_read(spark, sf_dir, "conversations"), "text", "role")


@query(f"WITH {C_CTE} SELECT token, occurrences FROM c")
def cleaned_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.ordered(_cleaned(spark, sf_dir))


#: Lines that are wrong, or right and without text, beside the props of events; twice one with text and U+FFFD.
LINES = ("", "   ", "{oops", "[1, 2]", '"text"', "7", '{"url": "x"}', '{"text": 5}', '{"text": null}', '{"text": "Aku aku kata-kata liputan6"}', '{"text": "caf� d\'or"}', '{"text": "caf� d\'or"}')
_LINES_SQL = ", ".join("('" + x.replace("'", "''") + "')" for x in LINES)
_JSON_SQL = f"""
WITH l AS (SELECT props AS v FROM events UNION ALL SELECT * FROM (VALUES {_LINES_SQL}) AS x(v)),
j AS (SELECT v, trim(v) = '' AS blank, CASE WHEN json_valid(v) THEN v ELSE 'null' END AS u, trim(v) <> '' AND json_valid(v) AS ok FROM l),
k AS (SELECT *, json_type(u) AS t FROM j),
x AS (SELECT *, ok AND t = 'OBJECT' AND coalesce(json_type(u, '$.text'), '') = 'VARCHAR' AS has FROM k)
SELECT count(*) AS lines_seen, count(*) FILTER (NOT blank AND ok) AS json_documents, count(*) FILTER (has) AS documents_with_text,
  count(*) FILTER (NOT blank AND NOT ok) AS malformed_json_lines, count(*) FILTER (NOT blank AND ok AND t <> 'OBJECT') AS non_object_json_lines,
  count(*) FILTER (NOT blank AND ok AND t = 'OBJECT' AND NOT has) AS missing_or_non_string_text, count(*) FILTER (contains(v, chr(65533))) AS utf8_replacement_lines,
  CAST(coalesce(sum(CASE WHEN has THEN len(regexp_extract_all(json_extract_string(u, '$.text'), '{RX}')) END), 0) AS BIGINT) AS tokens_seen FROM x"""


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(x,) for x in LINES], "value string")
    return _read(spark, sf_dir, "events").select(F.col("props").alias("value")).unionByName(own)


@query(_JSON_SQL)
def json_ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.metrics(corpus.classify(_json_lines(spark, sf_dir)))


@query(_JSON_SQL)
def json_ingest_metrics_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.metrics(corpus.classify(_json_lines(spark, sf_dir), exact=False))


# Headwords and set operations.


@query(f"WITH {H_CTE} SELECT headword, sources FROM h")
def headword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headwords(spark, sf_dir).select("headword", F.array_join("sources", "|").alias("sources"))


@query(
    "SELECT headword, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM (SELECT unnest(string_split(p_name, ' ')) AS headword, p_brand AS source FROM part) WHERE headword <> '' GROUP BY headword"
)
def headword_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ", -1)).alias("headword"), F.col("p_brand").alias("source"))
    return headwords.index(lines).select("headword", F.array_join("sources", "|").alias("sources"))


@query(f"WITH {F_CTE}, {H_CTE} SELECT token, occurrences FROM f WHERE EXISTS (SELECT 1 FROM h WHERE h.headword = f.token)")
def headword_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.intersect(_frequency(spark, sf_dir), _headwords(spark, sf_dir))


#: For the review queries, headwords of documents in French only: others have nearly all cleaned tokens as headwords.
def _some_headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headwords(spark, sf_dir).where(F.array_contains("sources", "fr"))


_N_SQL = f"{C_CTE}, {H_CTE}, n AS (SELECT token, occurrences FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.headword = lower(c.token) AND contains(sources, 'fr')) ORDER BY occurrences DESC, token LIMIT {review.MOST})"


@query(f"WITH {_N_SQL} SELECT token, occurrences FROM n")
def non_headword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.non_headwords(_cleaned(spark, sf_dir), _some_headwords(spark, sf_dir))


@query(
    f"""WITH {C_CTE}, {H_CTE}, m AS (SELECT token, occurrences, EXISTS (SELECT 1 FROM h WHERE h.headword = lower(c.token) AND contains(sources, 'fr')) AS hit FROM c),
    r AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (ORDER BY occurrences DESC, token ROWS UNBOUNDED PRECEDING) AS kept FROM m),
    s AS (SELECT * FROM r WHERE kept < {review.MOST} OR (kept = {review.MOST} AND NOT hit))
    SELECT count(*) FILTER (NOT hit) AS non_headword_rows, count(*) AS scanned_rows, count(*) FILTER (hit) AS matched_rows FROM s"""
)
def review_scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.scan_metrics(_cleaned(spark, sf_dir), _some_headwords(spark, sf_dir))


_SEED_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {k} AS group_no, row_number() OVER (ORDER BY occurrences DESC, token) AS position, token, occurrences FROM n WHERE length(token) >= {least} ORDER BY occurrences DESC, token LIMIT {review.PER_GROUP})"
    for k, least in enumerate((0, review.MEDIUM, review.LONG), 1)
)


@query(f"WITH {_N_SQL} {_SEED_SQL}")
def review_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.seed(non_headword_rows(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_N_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, token) AS position FROM n) SELECT token, occurrences, position, CAST((position - 1) // {review.BATCH} AS INTEGER) AS batch FROM p")
def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.batches(non_headword_rows(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


# Variants, rules and candidates.

#: Upper case of sharp s is two letters, as in full case mapping.
_CAP = "concat(CASE WHEN starts_with({0}, 'ß') THEN 'SS' ELSE upper(substr({0}, 1, 1)) END, substr({0}, 2))"
_VARIANTS = f"""
v1 AS (SELECT token, 0 AS o, token AS text, '' AS chain FROM b UNION ALL SELECT token, 1, lower(token), 'decapitalize' FROM b WHERE lower(token) <> token),
v2 AS (SELECT token, text, arg_min(chain, o2) AS chain, min(o2) AS o FROM (
  SELECT token, 2 * o AS o2, text, chain FROM v1 UNION ALL SELECT token, 2 * o + 1, {_CAP.format('text')}, CASE WHEN {_CAP.format('text')} = text THEN chain ELSE ltrim(concat(chain, '|capitalizeFirstLetter'), '|') END FROM v1
) GROUP BY token, text),
v3 AS (SELECT token, text, arg_min(chain, o3) AS chain, min(o3) AS o FROM (
  SELECT token, 2 * o AS o3, text, chain FROM v2 UNION ALL SELECT token, 2 * o + 1, strip_accents(text), CASE WHEN strip_accents(text) = text THEN chain ELSE ltrim(concat(chain, '|removeAlphabeticDiacritics'), '|') END FROM v2
) GROUP BY token, text)"""


def _joined(v: DataFrame) -> DataFrame:
    return v.select("token", F.posexplode("variants").alias("ord", "v")).select("token", (F.col("ord") + 1).cast("long").alias("ord"), "v.text", F.array_join("v.preprocessors", "|").alias("preprocessors"))


@query(f"WITH {F_CTE}, b AS (SELECT token FROM f), {_VARIANTS} SELECT token, row_number() OVER (PARTITION BY token ORDER BY o) AS ord, text, chain AS preprocessors FROM v2")
def text_variants_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _frequency(spark, sf_dir).select("token")
    return _joined(found.withColumn("variants", candidates.variant_columns(F.col("token"))))


@query(f"WITH {F_CTE}, b AS (SELECT token FROM f), {_VARIANTS} SELECT token, row_number() OVER (PARTITION BY token ORDER BY o) AS ord, text, chain AS preprocessors FROM v3")
def text_variants_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(candidates.with_variants(_frequency(spark, sf_dir).select("token")))


@query(f"WITH {F_CTE} SELECT token, strip_accents(token) AS plain FROM f")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequency(spark, sf_dir).select("token", without_diacritics(F.col("token")).alias("plain"))


def _steps_sql(source: str, transform: int | None, *keep: str) -> str:
    parts = []
    for g, t, _, r in rules.RULES:
        if transform in (None, t):
            condition, made = rules.rule_sql(r, "text")
            parts.append(f"CASE WHEN {condition} THEN {{'rule': {g}, 'text': {made}, 'conditions': {r.condition}}} END")
    return f"SELECT {', '.join(keep)}, x.rule AS rule, x.text AS text, x.conditions AS conditions FROM (SELECT *, unnest([{', '.join(parts)}]) AS x FROM {source}) WHERE x IS NOT NULL"


def _add_steps() -> None:
    for k, t in enumerate(rules.TRANSFORMS):
        name = "rule_step_" + "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.id.lower()).split())

        def step(spark: SparkSession, sf_dir: str, k: int = k) -> DataFrame:
            found = _lower_tokens(spark, sf_dir).select("token", F.explode(rules.steps(F.col("token"), k)).alias("x"))
            return found.select("token", F.col("x.g").alias("rule"), "x.text", "x.conditions")

        QUERIES[name] = step
        ORACLES[name] = f"WITH {T_CTE}, s AS (SELECT token, token AS text FROM t) {_steps_sql('s', k, 'token')}"


_add_steps()


@query(f"WITH {T_CTE} SELECT token, {rules.active_sql('token')} AS active FROM t")
def active_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lower_tokens(spark, sf_dir).select("token", rules.active_column(F.col("token")).alias("active"))


@query(
    f"""WITH {T_CTE}, s0 AS (SELECT token, token AS text, 0 AS conditions, 0 AS depth FROM t),
    s1 AS MATERIALIZED (SELECT DISTINCT token, text, conditions FROM ({_steps_sql('s0', None, 'token')})),
    s2 AS (SELECT DISTINCT token, text, conditions FROM ({_steps_sql('(SELECT token, text FROM s1 WHERE conditions = 0)', None, 'token')}))
    SELECT token, text, conditions, min(depth) AS depth FROM (SELECT * FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2) GROUP BY ALL"""
)
def candidates_depth_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.upto_depth(_lower_tokens(spark, sf_dir), 2)


_NAMES_SQL = "CASE " + " ".join(f"WHEN g <= {max(g for g, t, _, _ in rules.RULES if t == k)} THEN '{x.id}'" for k, x in enumerate(rules.TRANSFORMS)) + " END"
_RULES_SQL = ", ".join(f"CASE WHEN {c} THEN {{'g': {g}, 'text': {m}, 'conditions': {r.condition}}} END" for g, _, _, r in rules.RULES for c, m in [rules.rule_sql(r, "text")])
#: b has the tokens; k their candidates with ranks.
_CANDIDATES = f"""{_VARIANTS},
o AS (SELECT token, text, chain, row_number() OVER (PARTITION BY token ORDER BY o) - 1 AS vord FROM v3),
e AS (SELECT token, vord, chain, text, 0 AS conditions, CAST([] AS INTEGER[]) AS path FROM o
  UNION ALL SELECT token, vord, chain, x.text, x.conditions, list_append(path, x.g) FROM (SELECT token, vord, chain, path, unnest([{_RULES_SQL}]) AS x FROM e WHERE conditions = 0) WHERE x IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY token, text ORDER BY vord, len(path), path) AS nth FROM e),
k AS MATERIALIZED (SELECT token, CAST(row_number() OVER (PARTITION BY token ORDER BY vord, len(path), path) AS INTEGER) AS rank, text, chain, path, conditions FROM w WHERE nth = 1)"""
_PART_CTE = f"pf AS (SELECT token, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(concat_ws(' ', p_name, p_type, p_brand), '{RX}')) AS token FROM part) GROUP BY token), b AS (SELECT token FROM pf)"


def _part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(_read(spark, sf_dir, "part").withColumn("_all", F.concat_ws(" ", "p_name", "p_type", "p_brand")), "_all")


@query(
    f"WITH RECURSIVE {F_CTE}, b AS (SELECT token FROM f), {_CANDIDATES} SELECT token, rank, text, chain AS preprocessors, array_to_string(list_transform(list_reverse(path), lambda g: {_NAMES_SQL}), '|') AS transforms, conditions FROM k"
)
def candidates_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates.generate_each(_frequency(spark, sf_dir))
    return found.select("token", "rank", "text", F.array_join("preprocessors", "|").alias("preprocessors"), F.array_join("transforms", "|").alias("transforms"), "conditions")


_RESOLVE = f"{F_CTE}, b AS (SELECT token FROM f), {_CANDIDATES}, {H_CTE}, r AS (SELECT k.token, k.rank, k.text, h.sources FROM k JOIN h ON h.headword = k.text)"
_RESOLVED = "SELECT f.token, f.occurrences, a.text AS resolution, a.rank AS resolution_rank, coalesce(a.sources, '') AS resolution_sources, n.n AS candidate_count FROM f JOIN (SELECT token, count(*) AS n FROM k GROUP BY token) n ON n.token = f.token LEFT JOIN (SELECT token, arg_min(text, rank) AS text, min(rank) AS rank, arg_min(sources, rank) AS sources FROM r GROUP BY token) a ON a.token = f.token"


@query(f"WITH RECURSIVE {_RESOLVE} {_RESOLVED}")
def resolve_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.by_token(candidates.generate_each(_frequency(spark, sf_dir), "occurrences"), _headwords(spark, sf_dir), "occurrences")
    return found.drop("words").withColumn("resolution_sources", F.array_join("resolution_sources", "|"))


@query(f"WITH RECURSIVE {_RESOLVE}, d AS ({_RESOLVED}) SELECT d.*, w.words FROM d JOIN (SELECT token, string_agg(text, '|' ORDER BY rank) AS words FROM k GROUP BY token) w ON w.token = d.token")
def wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents with their resolution and all their candidates by rank."""
    found = resolve.by_token(candidates.generate_each(_frequency(spark, sf_dir), "occurrences"), _headwords(spark, sf_dir), "occurrences")
    return found.withColumns({"resolution_sources": F.array_join("resolution_sources", "|"), "words": F.array_join("words", "|")})


@query(
    f"WITH RECURSIVE {_PART_CTE}, {_CANDIDATES} SELECT pf.token, pf.occurrences, "
    + ", ".join(f"max(CASE WHEN k.rank = {n} THEN k.text END) AS word{n}" for n in range(1, 9)) + " FROM pf JOIN k ON k.token = pf.token GROUP BY ALL"
)
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of parts with a column for each of eight candidates; without a number, resolve.wide() has one for every rank."""
    found = _part_tokens(spark, sf_dir)
    return resolve.wide(found, candidates.generate_each(found), 8)


_TRACES = f"x AS (SELECT f.token, count(r.text) AS hit_count, count(r.text) = 0 AS is_fatal, CASE WHEN count(r.text) = 0 THEN concat(f.token, ' {resolve.FATAL}') ELSE concat(f.token, ', ', string_agg(r.text, ', ' ORDER BY r.rank)) END AS line FROM f LEFT JOIN r ON r.token = f.token GROUP BY f.token)"


@query(f"WITH RECURSIVE {_RESOLVE}, {_TRACES} SELECT token, CAST(hit_count AS INTEGER) AS hit_count, is_fatal, line FROM x")
def debug_trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.traces_by_token(candidates.generate_each(_frequency(spark, sf_dir)), _headwords(spark, sf_dir))


_FIRST = f"SELECT role, token, min(turn) AS line_no FROM (SELECT role, turn, unnest(regexp_extract_all(text, '{RX}')) AS token FROM conversations) GROUP BY role, token"


@query(
    f"""WITH RECURSIVE l AS ({_FIRST}), q AS (SELECT token, min(role) AS role FROM l GROUP BY token), f AS (SELECT token, 1 AS occurrences FROM q), b AS (SELECT token FROM q),
    {_CANDIDATES}, {H_CTE}, r AS (SELECT k.token, k.rank, k.text, h.sources FROM k JOIN h ON h.headword = k.text), {_TRACES}
    SELECT q.role, x.token, CAST(x.hit_count AS INTEGER) AS hit_count, x.is_fatal, x.line FROM x JOIN q ON q.token = x.token"""
)
def debug_trace_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces over several inputs (the roles of conversations): the first row of each token, fatal ones first, then by collation."""
    said = _read(spark, sf_dir, "conversations").select("role", F.col("turn").alias("line_no"), F.explode(tokens("text")).alias("token"))
    once = resolve.first_per(said.distinct(), ["token"], ["role", "line_no"]).select("role", "token")
    return resolve.combined(resolve.traces(once, candidates.generate(once), _headwords(spark, sf_dir)))


@query("SELECT name, flags FROM (VALUES ('v', 1), ('unknown', 0), ('v unknown', 1), ('', 0)) AS t(name, flags)")
def condition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["v", "unknown", "v unknown", ""]
    return spark.createDataFrame([(n, candidates.INDONESIAN.of(n.split())) for n in names], "name string, flags int")


@query("SELECT a, b, a = 0 OR (a & b) <> 0 AS matched FROM (SELECT CAST(x.n_nationkey % 4 AS INTEGER) AS a, CAST(y.r_regionkey AS INTEGER) AS b FROM nation x JOIN region y ON y.r_regionkey = x.n_regionkey)")
def conditions_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select((F.col("n_nationkey") % 4).cast("int").alias("a"), F.col("r_regionkey").cast("int").alias("b"))
    return rows.select("a", "b", candidates.conditions_match(F.col("a"), F.col("b")).alias("matched"))


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


@query(f"WITH t(id, name, description) AS (VALUES {', '.join(f'({_text(t.id)}, {_text(t.name)}, {_text(t.description)})' for t in rules.TRANSFORMS)}), q(id) AS (VALUES ('meN-'), ('passive di-'), ('circumfix'), ('simple prefix'), ('no such rule')) SELECT q.id, coalesce(t.name, q.id) AS name, t.description FROM q LEFT JOIN t ON t.id = q.id")
def inflection_rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in ("meN-", "passive di-", "circumfix", "simple prefix", "no such rule")], "id string")
    return candidates.transform_names(asked)


# Cases. Conversations give lines: the first tokens of each text as a case, with the next as its tail.

_CASE_SQL = f"""
l AS (SELECT conv_id, turn, regexp_extract_all(text, '{RX}') AS t FROM conversations),
p AS (SELECT conv_id, turn, t[1] AS token, t[2:3] AS prefix, t[4:5] AS tail FROM l WHERE len(t) > 0)"""


def _case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens("text")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t")).where(F.size("t") > 0)
    return rows.select("conv_id", "turn", cases.line_of(F.col("t")[0], F.slice("t", 2, 2), F.slice("t", 4, 2)).alias("line"))


@query(f"WITH {_CASE_SQL} SELECT conv_id, turn, token, array_to_string(prefix, '|') AS prefix_hits, array_to_string(tail, '|') AS fuzzy_tail_hits, CAST(NULL AS VARCHAR) AS error FROM p")
def parse_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written and parsed again."""
    found = cases.parse(_case_lines(spark, sf_dir))
    return found.select("conv_id", "turn", "token", F.array_join("prefix_hits", "|").alias("prefix_hits"), F.array_join("fuzzy_tail_hits", "|").alias("fuzzy_tail_hits"), "error")


@query(f"WITH {_CASE_SQL}, r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY token, prefix, tail) - 1 AS duplicates FROM p WINDOW w AS (PARTITION BY token, prefix, tail ORDER BY conv_id, turn)) SELECT conv_id, turn, token, array_to_string(prefix, '|') AS prefix_hits, array_to_string(tail, '|') AS fuzzy_tail_hits, duplicates FROM r WHERE n = 1")
def materialize_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cases.materialize(cases.parse(_case_lines(spark, sf_dir)).drop("error", "line"), ("conv_id", "turn"))
    return found.select("conv_id", "turn", "token", F.array_join("prefix_hits", "|").alias("prefix_hits"), F.array_join("fuzzy_tail_hits", "|").alias("fuzzy_tail_hits"), "duplicates")


@query(
    f"""WITH RECURSIVE {_CASE_SQL}, b AS (SELECT DISTINCT token FROM p), {_CANDIDATES}, {H_CTE},
    a AS (SELECT k.token, list(k.text ORDER BY k.rank) AS actual FROM k JOIN h ON h.headword = k.text GROUP BY k.token),
    j AS (SELECT p.*, coalesce(a.actual, []) AS actual FROM p LEFT JOIN a ON a.token = p.token),
    m AS (SELECT *, actual[1:len(prefix)] = prefix AS prefix_ok, list_filter(tail, lambda x: NOT list_contains(actual[len(prefix) + 1:], x)) AS missing FROM j)
    SELECT conv_id, turn, token, prefix_ok, array_to_string(missing, '|') AS missing_tail, prefix_ok AND len(missing) = 0 AS passed FROM m"""
)
def regression_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = cases.parse(_case_lines(spark, sf_dir)).drop("line", "error")
    made = candidates.generate(parsed)
    hits = resolve.hits(made, _headwords(spark, sf_dir)).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
    found = cases.evaluate(parsed, hits.select("token", F.transform("h", lambda x: x["text"]).alias("actual")))
    return found.select("conv_id", "turn", "token", "prefix_ok", F.array_join("missing_tail", "|").alias("missing_tail"), "passed")


# Files and streams.


@query(f"WITH {F_CTE} SELECT token, occurrences FROM f")
def count_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/counts"
    tables.write_parts(_frequency(spark, sf_dir), path)
    return tables.read_counts(spark, path)


@query(f"WITH {H_CTE} SELECT headword, sources FROM h")
def provenance_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/provenance"
    _headwords(spark, sf_dir).write.mode("overwrite").json(path, compression="gzip")
    return spark.read.schema("headword string, sources array<string>").json(path).select("headword", F.array_join("sources", "|").alias("sources"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {F_CTE} SELECT token, occurrences FROM f")
def streaming_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scratch(spark)
    made = streaming.run_to(streaming.counts(streaming.read_parquet(spark, f"{sf_dir}/documents.parquet")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(made) if made else spark.createDataFrame([], "token string, occurrences long")


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one where that is unset."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kataflow-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base}/scratch-{uuid.uuid4().hex}"
