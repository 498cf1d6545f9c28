"""Incremental runs with Structured Streaming: only new files are read, a restart resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mailtables.plans import ingest
from mailtables.sinks import tables
from mailtables.sources import listing

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
BATCH_BYTES = 64 << 30


def stream_files(spark: SparkSession, root: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Names of new files below `root` as they appear; the checkpoint remembers them. Contents are not read here.

    A micro-batch has about `batch_bytes` bytes of input, however many files those are.
    """
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxBytesPerTrigger", batch_bytes)
        .load(root)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    )


def run(
    new_files: DataFrame,
    store: str,
    checkpoint: str,
    name: str,
    config: dict,
    xml: str = "always",
    make_encoder: Callable | None = None,
    model: Callable[[Column], Column] | None = None,
    duplicates: str = "skip",
    limits: ingest.Limits = ingest.Limits(),
    whole_bytes: int = listing.WHOLE_BYTES,
) -> StreamingQuery:
    """Ingest everything new in a stream of file names, of every kind and in archives too, then stop.

    Each micro-batch becomes the store batch `<name>-<id>`. It is staged, de-duplicated against the store and
    committed in that order; a batch that is run again after a failure replaces itself. Messages whose id is
    already stored are skipped unless `duplicates` says `"replace"`.
    """

    def handle(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        batch = f"{name}-{batch_id}"
        if batch in tables.written(spark, store):
            return
        staged = f"{store}/staged/batch={batch}"
        files.write.mode("overwrite").parquet(f"{staged}/files")
        files = spark.read.parquet(f"{staged}/files")
        ingest.stage_files(files, staged, xml, limits, whole_bytes)
        ingest.store_batch(spark, staged, store, config, batch, make_encoder, model, duplicates, limits)

    return (
        new_files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(availableNow=True)
        .start()
    )


def run_mail(
    spark: SparkSession, root: str, store: str, checkpoint: str, config: dict, name: str = "mail",
    batch_bytes: int = BATCH_BYTES, **options,
) -> None:
    """One incremental run over everything below `root`."""
    run(stream_files(spark, root, batch_bytes), store, checkpoint, name, config, **options).awaitTermination()
