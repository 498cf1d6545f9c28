"""Positions of messages in their mbox file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailtables.operators.dedupe import broadcast_if_small


def number_messages(messages: DataFrame, raw: DataFrame | None = None, check_size: bool = False) -> DataFrame:
    """Add `position`: the place of a message in its file, from 0.

    Each row knows its place within its split, so only one row per split is shuffled to find where each split
    starts; a large mailbox is never gathered in one task. `raw` may give the same rows before parsing, which
    are cheaper to count. `check_size` counts the splits and broadcasts a short list, so that `messages` is not
    shuffled; use it on stored tables.
    """
    counted = messages if raw is None else raw
    splits = counted.groupBy("path", "block").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    if check_size:
        starts = broadcast_if_small(starts)
    return (
        messages.join(starts, ["path", "block"])
        .withColumn("position", F.col("_start") + F.col("ordinal"))
        .drop("_start")
    )
