"""Tables written to the shared folder between jobs, and joins whose small side is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtables.session import scratch_dir

#: A side is broadcast only below both bounds; both are counted on a written table.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def saved(rows: DataFrame, label: str, **options) -> DataFrame:
    """Write `rows` to the shared folder and read them back: cuts the lineage, survives lost executors."""
    spark = rows.sparkSession
    folder = scratch_dir(spark, label)
    rows.write.options(**options).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def lookup(rows: DataFrame, text: str | None = None) -> DataFrame:
    """`rows` (a written table) marked for broadcast if its counted rows, and bytes of `text`, are within the bounds.

    Beyond them it is returned as it is, and a join with it shuffles both sides.
    """
    width = F.sum(F.octet_length(text)) if text else F.lit(0)
    count, wide = rows.agg(F.count("*"), width).first()
    return F.broadcast(rows) if count <= BROADCAST_ROWS and (wide or 0) + 32 * count <= BROADCAST_BYTES else rows


def packed(rows: DataFrame, name: str, without: tuple[str, ...] = ()) -> DataFrame:
    """All columns of `rows` in one struct column, so that no name of theirs can clash with added ones."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in without]).alias(name))
