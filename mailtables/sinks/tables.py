"""The stored tables: Parquet folders, one partition per committed batch.

    <store>/<table>/batch=<name>/...     rows of one batch
    <store>/inputs/batch=<name>/...      the files that batch has read
    <store>/errors/batch=<name>/...      what in them it could not read
    <store>/replaced/batch=<name>/...    which rows of earlier batches it replaces
    <store>/manifest/batch=<name>/...    written last; a batch without it is not visible

A batch that fails is written again under the same name and replaces what it left behind, so every write may be
repeated after a lost executor or driver.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from mailtables.schema import EMBEDDINGS, TABLES

INPUTS = "path string, modified timestamp"
REPLACED = "message_id bigint, old_batch string"
REPLACED_CALENDARS = "path string, old_batch string"
ERRORS = "path string, block bigint, ordinal bigint, stage string, reason string"
# Stored events also know the calendar they came from.
LAYOUTS = TABLES | {
    "events": f"{TABLES['events']}, path string", "embeddings": EMBEDDINGS, "inputs": INPUTS, "errors": ERRORS,
    "replaced": REPLACED, "replaced_calendars": REPLACED_CALENDARS,
    "merged": "old_batch string", "manifest": "batch_rows bigint",
}
# Tables whose rows go when their message is replaced.
_OF_MESSAGES = {"messages", "attachments", "entities", "account_tags", "embeddings"}


def _read(spark: SparkSession, store: str, table: str) -> DataFrame:
    schema = StructType.fromDDL(LAYOUTS[table]).add("batch", "string")
    try:
        return spark.read.schema(schema).parquet(f"{store}/{table}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def written(spark: SparkSession, store: str) -> list[str]:
    """Names of all batches ever committed, from the names of the manifest's files; no job is run."""
    files = _read(spark, store, "manifest").inputFiles()
    return sorted({unquote(match[1]) for file in files if (match := re.search(r"/batch=([^/]+)/", file))})


def committed(spark: SparkSession, store: str) -> list[str]:
    """Names of the batches that make up the store: the committed ones, without those merged into a later one."""
    names = written(spark, store)
    merged = _read(spark, store, "merged").where(F.col("batch").isin(names))
    if not merged.inputFiles():
        return names
    gone = {row["old_batch"] for row in merged.select("old_batch").collect()}  # one row per batch
    return [name for name in names if name not in gone]


def read_table(
    spark: SparkSession, store: str, table: str, keep_batch: bool = False, batches: list[str] | None = None,
    whole: bool = False,
) -> DataFrame:
    """A stored table: committed batches only, without the rows that later batches have replaced.

    `whole` keeps the columns that only the store itself uses.

    The batch filter prunes folders. The list of replaced rows names them by (message_id, batch), a key that
    spreads evenly; Spark broadcasts it while its files are small.
    """
    visible = committed(spark, store) if batches is None else batches
    rows = _read(spark, store, table).where(F.col("batch").isin(visible))
    key, listed = ("path", "replaced_calendars") if table == "events" else ("message_id", "replaced")
    if table == "events" or table in _OF_MESSAGES:
        replaced = _read(spark, store, listed).where(F.col("batch").isin(visible))
        if replaced.inputFiles():
            gone = replaced.select(key, F.col("old_batch").alias("batch"))
            rows = rows.join(gone, [key, "batch"], "left_anti").select(*rows.columns)
    if table == "events" and not whole:
        rows = rows.drop("path")
    return rows if keep_batch else rows.drop("batch")


def write_batch(rows: DataFrame, store: str, table: str, batch: str) -> None:
    """Write a table's rows of one batch, replacing an earlier attempt."""
    rows.write.mode("overwrite").parquet(f"{store}/{table}/batch={batch}")


def commit(spark: SparkSession, store: str, batch: str, count: int) -> None:
    spark.createDataFrame([(count,)], LAYOUTS["manifest"]).coalesce(1).write.mode("overwrite").parquet(
        f"{store}/manifest/batch={batch}"
    )


def compact(spark: SparkSession, store: str, name: str) -> None:
    """Write the store's batches anew as the one batch `name`, without replaced rows and in few files per table.

    Many small batches, as streams leave them, are slow to list and to read. The new batch becomes visible and the
    old ones go out of sight together, when it is committed; their folders may be deleted after that. Repeating a
    compaction that failed writes the batch again; one that was committed is left alone.
    """
    if name in written(spark, store):
        return
    old = committed(spark, store)
    for table in [*TABLES, "embeddings", "inputs", "errors"]:
        rows = read_table(spark, store, table, batches=old, whole=True)
        write_batch(rows.hint("rebalance"), store, table, name)
    write_batch(spark.createDataFrame([(batch,) for batch in old], "old_batch string"), store, "merged", name)
    commit(spark, store, name, len(old))


def table_counts(spark: SparkSession, store: str) -> DataFrame:
    """(table_name, row_count) of the five tables."""
    counts, batches = None, committed(spark, store)
    for table in TABLES:
        one = read_table(spark, store, table, batches=batches).agg(F.count("*").alias("row_count"))
        one = one.select(F.lit(table).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts
