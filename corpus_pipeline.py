"""A corpus pipeline over `documents`: language ID, near duplicates, benchmark passages, secrets, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet
in the shared folder and reads it again as the next stage's documents. Stages keep all columns of
`documents`; the last one returns ids. Null and empty texts have no language and go in the first
stage; of repeated rows one stays after the second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, language, near_dedup, pieces, secrets
from logloom.llm.text import row_keys
from logloom.session import run_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    model = language.train(docs, "doc_id", "text", "lang")
    found = language.identify(
        docs, model, text_col="text", declared=F.col("lang"), host=F.col("source"), out="__language")
    return found.filter("__language.accepted").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew where something was replaced."""
    one, two = row_keys("doc_id", "text")
    keyed = docs.withColumns({"__k1": one, "__k2": two})
    scan = secrets.scan_secrets(keyed.withColumn("__key", F.struct("__k1", "__k2")), id_col="__key")
    found = secrets.merged_spans(scan).select(F.col("doc_id.__k1"), F.col("doc_id.__k2"), F.col("pieces").alias("__pieces"))
    joined = keyed.join(found, ["__k1", "__k2"], "left")
    has = F.col("__pieces").isNotNull()
    redacted = joined.withColumn("text", F.when(has, secrets.redact(F.col("text"), F.col("__pieces"))).otherwise(F.col("text")))
    return redacted.withColumn(
        "n_chars", F.when(has, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", benchmark_stage),
    ("secret_scan", secret_stage),
    ("piece_encoding", piece_stage),
]

# sampling, near duplicates and a trained model are not expressible in SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    folder = run_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
