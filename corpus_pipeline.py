"""From raw documents to packed training batches: language, lines, near-duplicates, secrets, packing.

Each stage works on all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm import langid, line_dedup, minhash, packing, secrets
from epiframe.llm.common import cut

#: No SQL for a fitted classifier or forest; tests hold the stages against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew where there is one."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or without a letter) go; a missing ``lang`` is filled in."""
    names = docs.columns
    found = langid.identify(docs, langid.fit(docs, "text", "lang")).filter(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*[F.col(f"`{c}`") for c in names])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and with them documents that consist of nothing else."""
    clean = line_dedup.drop_recurring_lines(docs)
    return _measured(clean.filter((F.col("lines_dropped") == 0) | F.col("text").rlike(r"\S")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; every document stays."""
    forest = secrets.fit(secrets.planted_findings(docs, path="source"), secrets.corpus_language(docs))
    return _measured(secrets.scan(docs, forest, path="source"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
