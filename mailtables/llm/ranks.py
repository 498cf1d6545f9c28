"""Positions in a seeded shuffle of each group, where one group may hold a third of all rows. Native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailtables.llm.stored import saved

#: Shuffle numbers are the first 15 hexadecimal digits of an MD5, so they lie below this.
SHUFFLE_RANGE = float(1 << 60)
_ROW_BITS = 33  # of monotonically_increasing_id()


def shuffle_number(value: Column, seed: str) -> Column:
    """A number from 0 to 2^60 - 1 that depends on the seed and the value's text only; null counts as no text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def running_total(rows: DataFrame, group: str, group_rows: str, order: list[str], amount: str) -> DataFrame:
    """Add `total`: the sum of `amount` up to and including the row, in its group, by `order`.

    `order` starts with the column of the row's shuffle number; `group_rows` is the number of rows in the row's group.
    A group is cut along the shuffle number into as many slices as the square root of its rows, so neither a slice nor
    the list of a group's slices grows as the group does, and no task gets a hot group whole.
    """
    cut = F.floor(F.col(order[0]) / F.lit(SHUFFLE_RANGE) * F.ceil(F.sqrt(F.col(group_rows)))).cast("bigint")
    rows = rows.withColumn("slice", cut)
    slices = rows.groupBy(group, "slice").agg(F.sum(amount).alias("in_slice"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(group, "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(slices, [group, "slice"])
        .withColumn("total", F.col("before") + F.sum(amount).over(inside))
        .drop("slice", "before")
    )


def range_sorted(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """`rows` sorted over all partitions and written, with `part` and `row`: the partition, and the place in it from 0.

    The order must tell all rows apart but repeated ones, so that it is the same whenever a task runs again.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("place", F.monotonically_increasing_id()), label)
    return placed.withColumns({
        "part": F.shiftright("place", _ROW_BITS),
        "row": F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    }).drop("place")
