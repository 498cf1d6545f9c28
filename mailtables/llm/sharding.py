"""Sharding by proportional stratified interleaving. Native columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailtables.llm.ranks import SHUFFLE_RANGE, range_sorted, running_total, shuffle_number
from mailtables.llm.stored import lookup, packed, saved

SHARDS = 16


def plan_shards(docs: DataFrame, shards: int = SHARDS, seed: str = "shard") -> DataFrame:
    """The shard and the slot in it of each document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    Rows are shuffled by `seed` within each source. A row's fractional rank is (place in its source + the source's
    phase) / (rows of the source), with a phase from 0 to 1 that only the source's name decides, so sources of one row
    each do not meet at one rank. All rows are sorted by fractional rank over all partitions and cut into `shards`
    equal runs: each run holds every source in proportion. The law is `rows`: counts differ by one at most. With
    another number of shards rows move, so `grown_shard` is null.

    `size` is the text's UTF-8 bytes plus 1; a null text has none, and the checksum of no bytes. A null source is a
    source. Ties go by shuffle number, id, size and checksum; rows that repeat all of these are alike, and each gets a
    slot of its own. With fewer rows than shards some shards are empty. Columns other than doc_id, source and text are
    not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = saved(
        docs.select(
            "doc_id", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-sizes",
    )
    rows = sizes.withColumns({
        "shuffled": shuffle_number(F.col("doc_id"), seed),
        "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        "one": F.lit(1),
    })
    sources = saved(sizes.groupBy("source").agg(F.count("*").alias("source_rows")), "shard-sources")
    sources = sources.withColumn("phase", shuffle_number(F.col("source"), f"{seed}-source") / F.lit(SHUFFLE_RANGE))
    names = lookup(sources, "source").withColumnRenamed("source", "name")
    joined = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    ties = ["shuffled", "id", "size", "text_crc32"]
    # null and an empty name stay apart
    joined = joined.withColumn("stratum", F.struct("source"))
    ranked = running_total(joined, "stratum", "source_rows", ties, "one")
    ranked = ranked.withColumn("fraction", (F.col("total") - 1 + F.col("phase")) / F.col("source_rows"))
    placed = range_sorted(
        ranked.select("fraction", *ties, "doc_id", "source"), ["fraction", *ties], "shard-sorted"
    )
    parts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(
        parts.select(
            "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
            F.sum("rows").over(Window.partitionBy()).alias("all_rows"),
        ),
        "shard-parts",
    )
    placed = placed.join(lookup(parts), "part").withColumn("place", F.col("before") + F.col("row"))
    shard = F.floor(F.expr(f"place * {shards} div all_rows"))
    start = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard(docs: DataFrame, **options) -> DataFrame:
    """`docs` with `shard` and `slot` added (columns of these names are replaced).

    Rows alike in id, source, size and checksum stand for each other; each keeps a slot of its own.
    """
    keys = ["doc_id", "source", "size", "text_crc32"]
    plan = plan_shards(docs, **options).select(*[F.col(k).alias(f"plan_{k}") for k in keys], "shard", "slot")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = packed(docs, "doc", without=("shard", "slot")).withColumns({
        "doc_id": F.col("doc.doc_id"), "source": F.col("doc.source"),
        "size": (F.octet_length(text) + 1).cast("bigint"), "text_crc32": F.crc32(text.cast("binary")),
    })
    same = [F.col(k).eqNullSafe(F.col(f"plan_{k}")) for k in keys]
    return plan.join(rows.dropDuplicates(keys), same).select("doc.*", "shard", "slot")


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(folder)
