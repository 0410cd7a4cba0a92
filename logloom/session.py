"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app_name: str = "logloom", **conf: str) -> SparkSession:
    """Build (or fetch) a session with the settings every operator assumes.

    The session zone must be UTC: all timestamps are instants and day
    partitions are UTC days.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone; safe to call on a session somebody else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a session that runs in one process may do without: it gets a scratch folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="logloom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def run_folder(spark: SparkSession) -> str:
    """A new folder under the shared one, for a job that stores tables of its own."""
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint in the shared folder (never executor-local storage)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
