"""Embedding sidecar files: JSON lines of message ids and excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(message_id, excerpt) of every line that can be read; other lines are skipped."""
    lines = spark.read.schema("message_id bigint, excerpt string").option("mode", "DROPMALFORMED").json(path)
    return lines.where("message_id IS NOT NULL")
