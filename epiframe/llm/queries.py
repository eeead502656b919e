"""Queries of the operators in this subpackage, each over its whole table, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_register("op3_byte_bpe")
def byte_bpe(spark, folder):
    import public_tokenizers

    from .bpe import round_trip
    return round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_register("op7_fingerprints")
def fingerprints(spark, folder):
    from .fingerprints import edited_likeness
    return edited_likeness(_table(spark, folder, "documents"))


@_register("op10_exact_dedup", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), g AS (SELECT doc_id, x, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g""")
def exact_dedup(spark, folder):
    from .exact_dedup import exact_groups
    return exact_groups(_table(spark, folder, "documents"), keep="max")


@_register("op1_quality_rules")
def quality_rules(spark, folder):
    from . import quality
    from .common import crc_remainder, cut
    docs = _table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    rows = cut(quality.with_statistics(docs))
    labels = _table(spark, folder, "labels").filter("quality IS NOT NULL").groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "label")
    model = quality.fit(rows.filter("NOT held_out").join(labels, "doc_id"), "label")
    return rows.withColumn("score", model.score()).selectExpr("doc_id", "held_out", "score", "CAST(score >= 0.7D AS INT) AS predicted")


@_register("op6_language_family")
def language_family(spark, folder):
    from . import langid
    from .common import crc_remainder
    docs = _table(spark, folder, "documents").withColumn("held_out", crc_remainder("doc_id", 3) == 1)
    model = langid.fit(docs.filter("NOT held_out"), "text", "lang")
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@_register("op5_minhash_tensor")
def minhash_tensor(spark, folder):
    from .minhash import near_duplicates
    return near_duplicates(_table(spark, folder, "documents"), width=2)


@_register("op4_line_templates")
def line_templates(spark, folder):
    from .line_dedup import drop_recurring_lines
    from pyspark.sql import functions as F
    docs = drop_recurring_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines_dropped", "chars_dropped", F.sha2("text", 256).alias("text_sha256"))


@_register("op9_length_buckets")
def length_buckets(spark, folder):
    from pyspark.sql import functions as F

    from .packing import pack, word_count
    return pack(_table(spark, folder, "documents"), word_count(F.col("text")))


@_register("op2_secret_forest")
def secret_forest(spark, folder):
    from pyspark.sql import functions as F

    from . import secrets
    docs = _table(spark, folder, "documents")
    forest = secrets.fit(secrets.planted_findings(docs, path="source"), secrets.corpus_language(docs))
    return secrets.scan(docs.select("doc_id", "source", "text"), forest, path="source").select("doc_id", "n_candidates", "n_secrets", "spans", F.sha2("text", 256).alias("text_sha256"))


@_register("op8_chat_roles")
def chat_roles(spark, folder):
    from pyspark.sql import functions as F

    from . import chat
    seen = chat.observed(chat.transcript_lines(_table(spark, folder, "conversations")), "conv_id", "line_no", "line")
    model = chat.fit(seen.filter(F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(3)) != 1), "role", "begins", "previous")
    parsed = chat.rendered(chat.recover_roles(seen, model))
    return parsed.select(F.col("conv").alias("conv_id"), "line_no", "role_pred", "turn_begin", "turn_no", "rendered", F.col("role").alias("role_true"), F.col("begins").alias("begin_true"))


@_register("op13_sentencepiece")
def sentencepiece(spark, folder):
    import public_tokenizers

    from .spiece import round_trip
    return round_trip(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_register("op12_token_alignment")
def token_alignment(spark, folder):
    import public_tokenizers

    from .alignment import alignment_counts
    return alignment_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@_register("op11_hard_negatives", """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS aid, a.vec_id AS anchor_id, b.uid, b.vec_id, a.lab = b.lab AS same, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.uid <> b.uid),
p AS (SELECT aid, anchor_id, uid AS pid, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST, uid) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.aid, pid ORDER BY score DESC, vec_id NULLS LAST, uid) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.aid = s.aid AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""")
def hard_negatives(spark, folder):
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings"), label=label)
