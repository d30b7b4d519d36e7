"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.line_dedup import line_dedup

    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), told AS (
  SELECT doc_id, i, line, o.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN often o USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.quality import quality

    done = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


#: Whoever runs this on data of their own passes a secret key instead.
PII_KEY = b"askbook public demonstration key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.toxicity import toxicity

    done = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted", "passages")


CHAT_BUDGET, CHAT_HISTORY = 2048, 256
CHAT_OWN = CHAT_BUDGET - CHAT_HISTORY


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.chat import digest, format_windows

    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(format_windows(turns, CHAT_BUDGET, CHAT_HISTORY))


OP5_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\r\f]')) + 4 AS tokens,
    row_number() OVER w - 1 AS ord,
    14 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##'), ': ', ':\ '))
      + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), placed AS (
  SELECT *, sum(tokens) OVER w - tokens AS before, sum(CASE WHEN tokens > {CHAT_OWN // 2} THEN 0 ELSE tokens END) OVER w - CASE WHEN tokens > {CHAT_OWN // 2} THEN 0 ELSE tokens END AS small_before,
    sum(CASE WHEN tokens > {CHAT_OWN // 2} THEN 1 ELSE 0 END) OVER w - CASE WHEN tokens > {CHAT_OWN // 2} THEN 1 ELSE 0 END AS larges_before, CASE WHEN tokens > {CHAT_OWN // 2} THEN 1 ELSE 0 END AS large,
    coalesce(max(tokens) FILTER (WHERE tokens <= {CHAT_OWN // 2}) OVER (PARTITION BY conv_id), 0) AS most, min(CASE WHEN role = 'system' THEN ord END) OVER (PARTITION BY conv_id) AS sys_ord
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY ord)
), celled AS (
  SELECT p.*, coalesce(s.tokens, 0) AS sys_tokens, coalesce(s.chars, 0) AS sys_chars, {CHAT_OWN} - coalesce(s.tokens, 0) - p.most AS room
  FROM placed p LEFT JOIN sized s ON s.conv_id = p.conv_id AND s.ord = p.sys_ord
), windowed AS (SELECT *, CASE WHEN room < {CHAT_OWN // 8} THEN 2 * ord + 1 ELSE small_before // greatest(room, 1) + 2 * larges_before + large END AS win FROM celled),
spans AS (
  SELECT conv_id, win, min(before) AS begins, min(ord) AS first_ord, sum(tokens) AS own, sum(chars) AS chars, any_value(sys_ord) AS sys_ord, any_value(sys_chars) AS sys_chars, any_value(sys_tokens) AS sys_tokens
  FROM windowed GROUP BY ALL
), again AS (
  SELECT s.conv_id, s.win, min(p.ord) AS first_ord, sum(p.chars) AS chars
  FROM spans s JOIN windowed p ON p.conv_id = s.conv_id AND p.before < s.begins AND p.before >= s.begins - least({CHAT_HISTORY}, greatest(0, {CHAT_BUDGET} - s.sys_tokens - s.own)) GROUP BY ALL
), written AS (
  SELECT s.conv_id, count(*) AS n_windows, sum(s.chars + coalesce(a.chars, 0) + CASE WHEN s.sys_ord < coalesce(a.first_ord, s.first_ord) THEN s.sys_chars ELSE 0 END) AS formatted_chars
  FROM spans s LEFT JOIN again a USING (conv_id, win) GROUP BY ALL
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord) AS said,
    coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '') AS target FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, n_windows
FROM said JOIN written USING (conv_id)
"""


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.flac import text_media

    done = text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.substring("pcm", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP8_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askbook.llm.bpe import decode, encode

    path = tokenizer("word_bpe_49k.json")
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_quality": op2_quality, "op3_pii": op3_pii, "op4_toxicity": op4_toxicity, "op5_chat": op5_chat, "op6_packing": op6_packing, "op7_flac": op7_flac, "op8_topk": op8_topk, "op9_bpe": op9_bpe, "op10_simhash": op10_simhash}
ORACLES = {"op1_line_dedup": OP1_SQL, "op5_chat": OP5_SQL, "op8_topk": OP8_SQL}
