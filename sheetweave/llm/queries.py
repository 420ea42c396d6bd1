"""The operators as queries over the whole driver tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, chat, katz, langid, mixing, packing, secret_scan, simhash, token_store, topk
from .common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.expand_examples(table.unionByName(extra)))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, 5)


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, secret_scan.BASE), F.sha2(secret_scan.spell(F.col("base")), 256).alias("base_sha256"), secret_scan.spell(F.col("spans")).alias("spans"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, tokenizer_path("byte_bpe_50k.json"))
    return token_store.read_documents(store, token_store.keys_of(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(~langid.in_fold(5, 0)))
    judged = langid.identify(docs.select("doc_id", "text"), filters).select("own.doc_id", "lang_pred", "lang_score")
    return judged.select("doc_id", langid.in_fold(5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents"), shingle=3)


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_exact_top_k, op3_pareto_mixing, op4_katz_backoff, op5_secret_scan, op6_token_store, op7_exact_dedup, op8_language_id, op9_packing, op10_simhash)}

ORACLE_SQL = {
    "op1_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
rendered AS (
  SELECT *, 24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS size FROM turns),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    role = 'assistant' AS target FROM rendered),
one AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (target), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (target), '')) AS loss_sha256,
    coalesce(sum(upto) FILTER (target), 0) + CASE WHEN coalesce(max(upto) FILTER (target), 0) < max(upto) THEN max(upto) ELSE 0 END AS formatted_chars,
    count(*) FILTER (target) AS n_examples, max(upto) AS stream_chars
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, n_examples, CAST(stream_chars AS BIGINT) AS stream_chars FROM one
""",
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""",
}


