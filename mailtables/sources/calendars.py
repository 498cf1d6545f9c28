"""Calendar files: VEVENT blocks to rows, in native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtables.functions.times import calendar_date
from mailtables.sources.files import GLOBS, scanned_path

_BEGIN = "\nBEGIN:VEVENT"


def read_ics(spark: SparkSession, root: str, glob: str = GLOBS["ics"]) -> DataFrame:
    """Calendar events of every `.ics` file.

    Rows end where a VEVENT begins, so a large calendar is split over many tasks.
    """
    blocks = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("lineSep", _BEGIN)
        .text(root)
        .select(
            scanned_path().alias("path"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("value").alias("block"),
        )
    )
    return parse_events(blocks)


def events_in_content(raw: DataFrame) -> DataFrame:
    """Calendar events of raw rows that hold whole files (entries of a zip)."""
    blocks = F.split(_valid(F.col("content").cast("string")), _BEGIN, -1)
    return parse_events(raw.select("path", "modified", F.explode(blocks).alias("block")))


def parse_events(blocks: DataFrame) -> DataFrame:
    """Rows of text between two VEVENT starts to the events table's columns.

    Folded lines are joined, the block is cut at its END line, and of each property the last value wins. What
    stands before the first event has no END line and goes.
    """
    unfolded = F.regexp_replace(F.regexp_replace(_valid(F.col("block")), "\r\n?", "\n"), "\n[ \t]", "")
    whole = blocks.withColumn("block", unfolded).where(
        F.col("block").rlike(r"\A(BEGIN:VEVENT)?[ \t]*\n") & F.col("block").rlike(r"\n[ \t]*END:VEVENT[ \t]*(\n|\z)")
    )
    event = F.regexp_replace(F.col("block"), r"(?s)\n[ \t]*END:VEVENT[ \t]*(\n.*|\z)", "")
    return whole.withColumn("block", event).select(
        "path",
        "modified",
        F.lit(None).cast("bigint").alias("message_id"),
        F.lit("calendar").alias("kind"),
        _last("SUMMARY").alias("title"),
        calendar_date(_last("DTSTART")).alias("starts_at"),
        calendar_date(_last("DTEND")).alias("ends_at"),
        _last("LOCATION").alias("location"),
        F.lit(None).cast("string").alias("extra"),
    )


def _valid(text: Column) -> Column:
    """The text without bytes that are not UTF-8."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))


def _last(name: str) -> Column:
    """The last value of a property; parameters after `;` are cut, names match in any case."""
    found = F.regexp_extract_all(F.col("block"), F.lit(f"(?imd)^{name}(?:;[^:\\n]*)?:(.*)$"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))
