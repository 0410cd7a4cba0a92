"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    chat,
    clustering,
    decontaminate,
    html_text,
    language,
    licenses,
    merkle,
    mixing,
    near_dedup,
    pieces,
    quality,
    secrets,
    suffix_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_secret_scan")
def op2(spark, sf_dir):
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


@query("op3_near_dedup")
def op3(spark, sf_dir):
    """Every document with the smallest id of its class of near duplicates."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query("op5_decontaminate")
def op5(spark, sf_dir):
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_piece_sampling")
def op6(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("op7_language")
def op7(spark, sf_dir):
    """All documents (declared language, source as host) and all pages (markup, address, host)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None)
    rows = docs.select(
        "doc_id", none.cast("bigint").alias("page_id"), "text", F.col("lang").alias("declared"),
        none.cast("string").alias("address"), F.col("source").alias("host"),
    ).unionByName(pages.select(
        none.cast("bigint").alias("doc_id"), "page_id", language.markup_text(F.col("html")).alias("text"),
        language.markup_language(F.col("html")).alias("declared"),
        language.address_language(F.col("url")).alias("address"), language.host_of(F.col("url")).alias("host"),
    ))
    model = language.train(docs, "doc_id", "text", "lang")
    found = language.identify(
        rows, model, text_col="text", declared=F.col("declared"), address=F.col("address"), host=F.col("host"))
    return found.select("doc_id", "page_id", "language.*")


@query("op8_license_scan")
def op8(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op9_chat_rotation", chat.ORACLE)
def op9(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query("op10_html_text")
def op10(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_source_mix")
def op11(spark, sf_dir):
    """Every document with its source's target and the words that the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "times")


@query("op12_clusters", clustering.oracle())
def op12(spark, sf_dir):
    return clustering.summary(clustering.cluster(table(spark, sf_dir, "embeddings")))


@query("op13_merkle_manifest", merkle.oracle())
def op13(spark, sf_dir):
    return merkle.audit(merkle.document_manifest(table(spark, sf_dir, "documents")))
