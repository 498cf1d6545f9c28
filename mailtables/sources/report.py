"""What an input folder holds, before anything is ingested."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtables.sources.files import list_files, open_file
from mailtables.sources.kinds import source_kind

# Kinds that cannot be read here; export them to one of the others first.
UNREADABLE = ["pst", "olm", "unsupported", "missing"]


def source_report(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, source_kind) of every file. Files are opened, for four bytes, only if their name says nothing."""
    listed = list_files(spark, root).select("path", "size_bytes", source_kind(F.col("path")).alias("source_kind"))
    unknown = listed.where(F.col("source_kind") == "unsupported").select("path", "size_bytes")
    headed = unknown.mapInArrow(_read_heads, "path string, size_bytes bigint, head binary")
    told = headed.select("path", "size_bytes", source_kind(F.col("path"), F.col("head")).alias("source_kind"))
    return listed.where(F.col("source_kind") != "unsupported").unionByName(told)


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for path in batch.column("path").to_pylist():
            try:
                with open_file(path) as file:
                    heads.append(file.read(4))
            except OSError:
                heads.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("size_bytes"), pa.array(heads, pa.binary())],
            names=["path", "size_bytes", "head"],
        )
