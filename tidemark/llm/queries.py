"""The operators on the given tables, and the pipeline; each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import blocks, chat, divergence, hard_negatives, langid, packing, perplexity, pii, sharding, simhash, suffixes, tiling, warc

VOCABULARY = "word_bpe_49k.json"
SHARDS, SEED = 24, 42


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op2_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.quality(table(spark, folder, "documents"))


def op3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.extract(table(spark, folder, "pages"))


def op4_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_hash")


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents"))


#: the two turns that look like control strings themselves
HOSTILE = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    hostile = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")),
                          F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit(HOSTILE).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(turns.unionByName(hostile))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.captures_round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    return sharding.shuffle_shards(rows, SHARDS, SEED).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", moved))


def op13_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"),
        (F.octet_length("body") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_perplexity, op3_blocks, op4_tiling, op5_pii, op6_chat, op7_simhash, op8_warc,
                            op9_langid, op10_sharding, op11_divergence,
                            op12_hard_negatives, op13_suffixes)} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op6_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\<>#]', '', 'g')) + length(text)
                + length(regexp_replace(text, '[^\\<>#]', '', 'g')) + length('<turn ' || '>' || chr(10) || '</turn>' || chr(10)) AS size FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        u AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM u GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(total) AS total FROM k GROUP BY lang),
        e AS (SELECT DISTINCT lang, source FROM d),
        g AS (SELECT e.lang, e.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total,
                coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total
              FROM e LEFT JOIN l USING (lang) LEFT JOIN c ON c.lang = e.lang AND c.source = e.source
              LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY e.lang, e.source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS BIGINT) AS p,
                CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.total + 2)) // (g.lang_total + 2 * g.v) AS BIGINT) AS q
              FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
              GROUP BY a.lang, a.source, b.source),
        own AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
        r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM own),
        s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM s WHERE part = 'pair' OR rank <= 10""",
    "op12_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
              FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
                CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p),
        b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
                + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM d),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to FROM m""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
