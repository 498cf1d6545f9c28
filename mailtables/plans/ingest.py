"""Ingest: a folder of mail, loose or in zip archives, into the stored tables, one batch per run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from mailtables.functions.text import excerpt
from mailtables.operators import dedupe, entities, parts, tagging
from mailtables.operators.vectors import encode_column
from mailtables.plans import messages as M
from mailtables.sinks import tables
from mailtables.sources import kinds, listing, mime, xml_messages


@dataclass(frozen=True)
class Limits:
    """How much of what lies beside an XML message is taken, and of a text for its embedding. By default all of it."""

    part_bytes: int | None = None
    body_chars: int | None = None
    attachment_names: int | None = None
    excerpt_chars: int | None = None


def unread(files: DataFrame, done: DataFrame) -> DataFrame:
    """The listed files that no earlier batch has read, by path and modification time."""
    return files.join(done.select("path", "modified"), ["path", "modified"], "left_anti")


def read_mail(contents: DataFrame) -> DataFrame:
    """Parsed mail of everything listed."""
    mail = listing.read_mbox(contents)
    for kind in ("eml", "emlx"):
        mail = mail.unionByName(listing.read_whole(contents.where(F.col("kind") == kind), kind))
    return mime.parse_mime(mail)


def read_xml(contents: DataFrame, around: DataFrame, staged: str, limits: Limits = Limits()) -> DataFrame:
    """XML message records with rebuilt bodies and attachments.

    `around` lists what may lie beside them. The flattened files are written first: they are used several times, to
    see which folders need their part files too, and only those folders' parts are opened.
    """
    spark = contents.sparkSession
    files = listing.read_whole(listing.xml_files(contents), "xml")
    xml_messages.flatten_xml(files).write.mode("overwrite").parquet(f"{staged}/xml_flat")
    xml = xml_messages.xml_messages(spark.read.parquet(f"{staged}/xml_flat"))
    needed = xml.where(F.col("body").isNull()).select("dir").distinct()
    own = around.withColumn("dir", parts.parent_dir(F.col("path"))).where(F.col("path").rlike(kinds.BODY_PART))
    beside = listing.read_whole(own.join(needed, "dir", "left_semi"), "part")
    bodies = parts.bodies_from_parts(
        parts.part_texts(beside.where(F.col("error").isNull()), limits.part_bytes), limits.body_chars
    )
    return M.xml_records(xml, bodies, parts.attachment_lists(around, limits.attachment_names))


def ingest(
    spark: SparkSession,
    root: str,
    store: str,
    config: dict,
    batch: str,
    xml: str = "always",
    make_encoder: Callable | None = None,
    model: Callable[[Column], Column] | None = None,
    duplicates: str = "replace",
    limits: Limits = Limits(),
    whole_bytes: int = listing.WHOLE_BYTES,
) -> None:
    """Read what is new below `root`, loose files and zip archives alike, and add it to the store as one batch.

    `xml` is `always`, `never` or `fallback` (only if there is no mail). `make_encoder` adds embeddings when the
    config enables `semantic`. `duplicates`: see `store_batch`. A file that has to be read whole and has more than
    `whole_bytes` bytes is not opened. Whatever cannot be read is a row of the `errors` table.
    """
    if batch in tables.written(spark, store):
        return
    staged = f"{store}/staged/batch={batch}"
    files = listing.list_root(spark, root)
    files.write.mode("overwrite").parquet(f"{staged}/files")
    files = spark.read.parquet(f"{staged}/files")
    new = unread(files, tables.read_table(spark, store, "inputs"))
    # parts and attachments of a new message may have been listed before it
    stage_files(new, staged, xml, limits, whole_bytes, files)
    store_batch(spark, staged, store, config, batch, make_encoder, model, duplicates, limits)


def stage_files(
    files: DataFrame, staged: str, xml: str = "always", limits: Limits = Limits(),
    whole_bytes: int = listing.WHOLE_BYTES, around: DataFrame | None = None,
) -> None:
    """Read listed files (path, modified, size_bytes), and no others, into `staged`.

    The list of files and zip entries is written first; every reader starts from it and opens only what it names.
    """
    spark = files.sparkSession
    listing.list_contents(files, whole_bytes).write.mode("overwrite").parquet(f"{staged}/listing")
    contents = spark.read.parquet(f"{staged}/listing")
    readable = contents.where(F.col("error").isNull())
    blocks = f"{staged}/calendars"
    listing.read_events(readable).write.mode("overwrite").parquet(blocks)
    events = listing.events_of(spark.read.parquet(blocks))
    with_xml = xml == "always" or xml == "fallback" and readable.where(F.col("kind").isin("eml", "mbox", "emlx")).isEmpty()
    beside = readable
    if around is not None:
        loose = around.join(readable.select("path"), "path", "left_anti")
        beside = readable.unionByName(listing.list_contents(loose.where(~F.col("path").rlike(kinds.ARCHIVE)), whole_bytes))
    extra = read_xml(readable, beside.where(F.col("error").isNull()), staged, limits) if with_xml else None
    stage(read_mail(readable), extra, events, staged)


def stage(parsed: DataFrame, xml: DataFrame | None, events: DataFrame | None, staged: str) -> None:
    """Write parsed input once; everything after reads columns of it instead of parsing again."""
    parsed.write.mode("overwrite").parquet(f"{staged}/parsed")
    if xml is not None:
        xml.write.mode("overwrite").parquet(f"{staged}/xml")
    if events is not None:
        events.write.mode("overwrite").parquet(f"{staged}/events")


def read_errors(spark: SparkSession, staged: str) -> DataFrame:
    """What could not be read: path, block and ordinal within it, stage, reason."""
    nowhere = (F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("ordinal"))

    def failed(rows: DataFrame, stage_name: str, *place: Column | str) -> DataFrame:
        return rows.where(F.col("error").isNotNull()).select(
            "path", *place, F.lit(stage_name).alias("stage"), F.col("error").alias("reason")
        )

    found = failed(_staged(spark, staged, "parsed"), "mail", "block", "ordinal")
    for part, stage_name, place in (
        ("listing", "listing", nowhere), ("calendars", "calendar", ("block", "ordinal")), ("xml_flat", "xml", nowhere),
    ):
        rows = _staged(spark, staged, part)
        if rows is not None:
            found = found.unionByName(failed(rows, stage_name, *place))
    return found


def _staged(spark: SparkSession, staged: str, part: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{staged}/{part}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def store_batch(
    spark: SparkSession,
    staged: str,
    store: str,
    config: dict,
    batch: str,
    make_encoder: Callable | None = None,
    model: Callable[[Column], Column] | None = None,
    duplicates: str = "replace",
    limits: Limits = Limits(),
) -> None:
    """Write the tables of one staged batch and commit it.

    Of messages with one external id, `duplicates="replace"` keeps the last one read, which takes the place of a
    stored one; `"skip"` keeps the first one, or the stored one.
    """
    parsed = _staged(spark, staged, "parsed")
    xml = _staged(spark, staged, "xml")
    records = M.all_records(parsed, xml)
    stored = tables.read_table(spark, store, "messages", keep_batch=True).where(F.col("batch") != batch)
    if duplicates == "skip":
        fresh = dedupe.keep_one(records, "external_id", M.READING_ORDER, "first", check_size=True)
        fresh = dedupe.not_stored(fresh, stored, "external_id", check_size=True)
    else:
        fresh = dedupe.keep_one(records, "external_id", M.READING_ORDER, "last", check_size=True)
        keys = dedupe.broadcast_if_small(records.select("external_id").distinct())
        replaced = stored.select("message_id", "external_id", F.col("batch").alias("old_batch"))
        replaced = replaced.join(keys, "external_id", "left_semi").drop("external_id")
        tables.write_batch(replaced, store, "replaced", batch)
    complete = M.complete(fresh, tagging.rules_from_config(config), model)

    # The messages files also hold the lists the narrow tables are made of, so bodies are written once. Readers
    # ask for the table's own columns. Sorted files let a query for one account or period skip row groups.
    # the rows are counted while they are written (an observation), not by a job of their own afterwards
    written = Observation(f"messages-{batch}")
    tables.write_batch(
        complete.observe(written, F.count(F.lit(1)).alias("rows")).sortWithinPartitions("account_tag", "sent_at"),
        store, "messages", batch,
    )
    complete = spark.read.parquet(f"{store}/messages/batch={batch}")
    tables.write_batch(M.attachment_rows(complete), store, "attachments", batch)
    tables.write_batch(entities.entity_rows(complete), store, "entities", batch)
    tables.write_batch(tagging.tag_rows(complete), store, "account_tags", batch)
    listed = _staged(spark, staged, "listing")
    events = _staged(spark, staged, "events")
    if events is not None:
        tables.write_batch(events.drop("modified"), store, "events", batch)
        # a calendar that is read again takes the place of what it held before
        calendars = events if listed is None else listed.where(F.col("kind") == "ics")
        earlier = tables.read_table(spark, store, "inputs", keep_batch=True).where(F.col("batch") != batch)
        again = earlier.select("path", F.col("batch").alias("old_batch")).join(calendars.select("path").distinct(), "path", "left_semi")
        tables.write_batch(again, store, "replaced_calendars", batch)
    if make_encoder is not None and (config.get("semantic") or {}).get("enabled"):
        texts = complete.select("message_id", excerpt(F.col("subject"), F.col("body"), limits.excerpt_chars).alias("excerpt"))
        encode = encode_column(make_encoder)
        tables.write_batch(texts.withColumn("embedding", encode("excerpt")), store, "embeddings", batch)
    tables.write_batch(read_errors(spark, staged), store, "errors", batch)
    if listed is not None:
        inputs = listed.select("path", "modified")
    else:
        inputs = parsed.select("path", "modified").distinct()
        for other in (xml, events):
            if other is not None:
                inputs = inputs.unionByName(other.select("path", "modified").distinct())
        inputs = inputs.distinct()
    tables.write_batch(inputs, store, "inputs", batch)
    tables.commit(spark, store, batch, written.get["rows"])
