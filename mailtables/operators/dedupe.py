"""Which rows to keep: one per key in a batch, only new ones against a store, the latest after an update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailtables.session import scratch_dir

# A written key list within both bounds is sent to every executor; a longer or wider one is shuffled.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(keys: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A key list, written once and read back, marked for broadcast if its counted rows and bytes prove it small.

    What made the list runs once, for the check and for the join together.
    """
    spark = keys.sparkSession
    folder = scratch_dir(spark, "keys")
    keys.write.parquet(folder)
    keys = spark.read.schema(keys.schema).parquet(folder)
    texts = [F.sum(F.octet_length(f.name)) for f in keys.schema.fields if isinstance(f.dataType, StringType)]
    rows, *widths = keys.agg(F.count("*"), *texts).first()
    size = sum(width or 0 for width in widths) + 16 * len(keys.columns) * rows
    return F.broadcast(keys) if rows <= max_rows and size <= max_bytes else keys


def keep_one(rows: DataFrame, key: str, order: list[str], keep: str = "first", check_size: bool = False) -> DataFrame:
    """One row per `key`: the first or last in `order`, whose columns with the key identify a row.

    Only key and order columns are grouped, and partly before the shuffle, so a key that holds a third of all
    rows stays cheap. The losing rows are then taken out by the full (key, order) identity, which spreads
    evenly however often one key repeats. `check_size` counts the losers first and broadcasts a short list, so
    that `rows` is not shuffled at all; use it on stored tables.
    """
    narrow = rows.select(key, *order)
    best = {"first": F.min, "last": F.max}[keep]
    winners = narrow.groupBy(key).agg(best(F.struct(*order)).alias("_best")).select(key, "_best.*")
    identity = [key, *order]
    losers = narrow.join(winners, identity, "left_anti")
    if check_size:
        losers = broadcast_if_small(losers)
    return rows.join(losers, identity, "left_anti")


def not_stored(batch: DataFrame, stored: DataFrame, key: str, check_size: bool = False) -> DataFrame:
    """Rows of `batch` whose key is not in `stored`.

    The store is first cut down to the batch's own keys; when those are few, the store is scanned (one column)
    but not shuffled.
    """
    keys = batch.select(key).distinct()
    if check_size:
        keys = broadcast_if_small(keys)
    known = stored.select(key).join(keys, key, "left_semi")
    if check_size:
        known = broadcast_if_small(known.distinct())
    return batch.join(known, key, "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: list[str], check_size: bool = False) -> DataFrame:
    """The store after inserting or replacing by key; the last row of the batch wins."""
    latest = keep_one(batch, key, order, keep="last", check_size=check_size)
    keys = latest.select(key)
    if check_size:
        keys = broadcast_if_small(keys)
    return stored.join(keys, key, "left_anti").unionByName(latest)
