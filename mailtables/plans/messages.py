"""From parsed rows to message records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.functions.ids import external_id, message_id, thread_id
from mailtables.operators.entities import add_entities
from mailtables.operators.tagging import Rules, tag_accounts
from mailtables.schema import ATTACHMENT, TABLES, columns

# What identifies an input row, in reading order.
READING_ORDER = ["modified", "path", "block", "ordinal"]


def mail_records(parsed: DataFrame) -> DataFrame:
    """Parsed mail to records; rows that could not be parsed are left to `parse_errors`."""
    return parsed.where(F.col("error").isNull()).select(
        *READING_ORDER,
        external_id(*[F.col(f"{c}_header") for c in ("id", "from", "date", "subject")]).alias("external_id"),
        thread_id(F.col("thread_index"), F.col("thread_topic")).alias("thread_id"),
        "sender_name",
        "sender_email",
        "recipients_to",
        "recipients_cc",
        "recipients_bcc",
        "subject",
        "body",
        "sent_at",
        "attachments",
    )


def xml_records(xml: DataFrame, bodies: DataFrame | None = None, attachments: DataFrame | None = None) -> DataFrame:
    """XML message records, empty bodies filled from part files and attachments found beside them."""
    filled = xml
    if bodies is not None:
        filled = filled.join(bodies.withColumnRenamed("body", "_rebuilt"), "dir", "left")
        filled = filled.withColumn("body", F.coalesce("body", F.nullif("_rebuilt", F.lit("")))).drop("_rebuilt")
    if attachments is not None:
        filled = filled.join(attachments, "dir", "left")
    else:
        filled = filled.withColumn("attachments", F.lit(None).cast(f"array<{ATTACHMENT}>"))
    return filled.select(
        "modified",
        "path",
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("ordinal"),
        "external_id",
        F.lit(None).cast("string").alias("thread_id"),
        F.col("sender_email").alias("sender_name"),
        "sender_email",
        "recipients_to",
        "recipients_cc",
        "recipients_bcc",
        "subject",
        "body",
        "sent_at",
        F.coalesce("attachments", F.array().cast(f"array<{ATTACHMENT}>")).alias("attachments"),
    )


def all_records(parsed: DataFrame, xml: DataFrame | None) -> DataFrame:
    """The records of a batch: its mail and its XML messages."""
    records = mail_records(parsed)
    return records if xml is None else records.unionByName(xml)


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("path", "block", "ordinal", "error")


def complete(records: DataFrame, rules: Rules, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Tags, entities and the remaining message columns."""
    tagged = add_entities(tag_accounts(records, rules), "body", model)
    return tagged.withColumns(
        {
            "message_id": message_id(F.col("external_id")),
            "folder": F.lit(None).cast("string"),
            "received_at": F.col("sent_at"),
            "is_read": F.lit(False),
            "has_attachments": F.size("attachments") > 0,
            "raw_headers": F.lit(None).cast("string"),
        }
    )


def message_rows(completed: DataFrame) -> DataFrame:
    """The columns of the messages table."""
    return completed.select(*columns(TABLES["messages"]))


def attachment_rows(completed: DataFrame) -> DataFrame:
    """Names, types and sizes; contents are not kept."""
    listed = completed.select("message_id", F.inline("attachments"))
    return listed.withColumn("content", F.lit(None).cast("binary"))
