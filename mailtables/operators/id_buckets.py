"""Point lookups by id: a stored table in hash-bucket folders, with Parquet bloom filters on the id.

A table is written with `id_bucket = pmod(xxhash64(id), BUCKETS)` as a folder level and a bloom filter on the id
column. Looking up some ids, or the ids of a micro-batch, first works out their buckets (a handful of numbers, on the
driver) and reads only those folders; within them the reader skips row groups whose bloom filter rules the ids out.
So a lookup of ten ids opens at most ten of the buckets, and a batch of new rows reads only the buckets its own ids
fall into, not the whole id column of the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtables.operators.dedupe import broadcast_if_small

#: Folders a table is cut into by the hash of its id.
BUCKETS = 64


def bucket_of(key) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def write_bucketed(rows: DataFrame, folder: str, key: str, mode: str = "append") -> None:
    """Append `rows` under `folder`, one folder per id bucket, each file with a bloom filter on `key`. Rows are only
    sorted within their task by bucket (no shuffle), so a task writes one file per bucket it holds; null ids go to
    the bucket of null (pmod of null is null), which Spark names `__HIVE_DEFAULT_PARTITION__`."""
    staged = rows.withColumn("id_bucket", bucket_of(F.col(key))).sortWithinPartitions("id_bucket", key)
    staged.write.mode(mode).partitionBy("id_bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(folder)


def buckets_of(spark: SparkSession, ids: list, kind: str = "bigint") -> list[int]:
    """The buckets of some ids of type `kind` (the stored key's), worked out by Spark's own hash."""
    if not ids:
        return []
    rows = spark.createDataFrame([(i,) for i in ids], f"id {kind}").select(bucket_of(F.col("id")).alias("b")).distinct()
    return sorted(r["b"] for r in rows.collect() if r["b"] is not None)


def lookup(spark: SparkSession, folder: str, key: str, ids: list) -> DataFrame:
    """The stored rows whose `key` is one of `ids` (a list the caller holds): only their buckets are read."""
    table = spark.read.parquet(folder)
    wanted = [i for i in ids if i is not None]
    kind = dict(table.dtypes)[key]
    return table.filter(F.col("id_bucket").isin(buckets_of(spark, wanted, kind)) & F.col(key).isin(wanted)).drop(
        "id_bucket"
    )


def batch_buckets(batch: DataFrame, batch_key: str) -> list[int]:
    """The buckets of a batch's ids: at most BUCKETS numbers reach the driver."""
    ids = batch.select(bucket_of(F.col(batch_key)).alias("b")).filter(F.col("b").isNotNull()).distinct()
    return sorted(r["b"] for r in ids.collect())


def matching(spark: SparkSession, folder: str, key: str, batch: DataFrame, batch_key: str | None = None) -> DataFrame:
    """The stored rows whose `key` occurs in `batch` (a micro-batch): the batch's buckets are counted first (at most
    BUCKETS numbers reach the driver), only those folders are read, and the batch's distinct ids are broadcast when
    counted small, else joined by a shuffle."""
    batch_key = batch_key or key
    ids = batch.select(F.col(batch_key).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    buckets = batch_buckets(ids, "_id")
    table = spark.read.parquet(folder).filter(F.col("id_bucket").isin(buckets))
    return table.join(broadcast_if_small(ids), F.col(key) == F.col("_id"), "left_semi").drop("id_bucket")
