"""The queries of this subpackage over the test tables, each with its operator's production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import byte_bpe, chat, dac, decontam, html_extract, neardup, token_count, topk, toxicity, warc
from sedimenta.session import scratch, ship

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_file_index(_table(spark, sf_dir, "documents"), WORD_BPE)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), WORD_BPE)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(_table(spark, sf_dir, "pages"))


#: A conversation of control strings, added to the table.
ESCAPES = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", ESCAPES), (-7, 1, "assistant", ESCAPES)], rows.schema)
    out = scratch(spark, "chat")
    chat.format_turns(chat.canonical_turns(rows.unionByName(extra))).write.parquet(out)
    return chat.conversation_digests(spark.read.parquet(out))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.exact_topk(vectors.where("id % 100 = 0"), vectors).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_warc, op3_token_counts, op4_main_text, op5_chat, op6_exact_topk, op7_near_duplicates, op8_byte_bpe, op9_decontamination, op10_toxicity)}


_ESCAPED = "replace(replace({0}, '\\', '\\\\'), '<', '\\l')"

#: DuckDB for the queries that SQL can express; the tokenizers, the page model, the classifier and the retrieval it can't.
ORACLES = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) || '00' AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (1 + (5 * i) // 4)::INTEGER, 3))::INTEGER >> (7 - (5 * i) % 4)::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op5_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{ESCAPES}' UNION ALL SELECT -7, 1, 'assistant', '{ESCAPES}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, (coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(15 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
    "op6_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 10""",
    "op7_near_duplicates": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
m AS (SELECT a.doc_id AS p, b.doc_id AS q, any_value(a.n) AS np, any_value(b.n) AS nq, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p, q FROM m WHERE 100 * k >= 85 * (np + nq - k)),
r(p, q) AS (SELECT p, q FROM l UNION SELECT r.p, l.q FROM r JOIN l ON r.q = l.p)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.q), s.doc_id)) AS component_id, s.doc_id <= coalesce(min(r.q), s.doc_id) AS kept FROM s LEFT JOIN r ON r.p = s.doc_id GROUP BY s.doc_id, s.g""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
