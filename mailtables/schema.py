"""Column layouts (DDL text): raw input, parsed input, the five tables and the embeddings."""

from __future__ import annotations

# One row per message source: a file, one message of an mbox file, or one zip entry.
# `error` says why it could not be read; it then has no content.
RAW = "path string, kind string, block bigint, ordinal bigint, modified timestamp, content binary, error string"

ATTACHMENT = "struct<filename:string,content_type:string,size_bytes:bigint>"
ENTITY = "struct<label:string,text:string,start_char:int,end_char:int>"
TAG = "struct<tag:string,kind:string>"

PARSED = (
    "path string, kind string, block bigint, ordinal bigint, modified timestamp, "
    "id_header string, from_header string, date_header string, subject_header string, "
    "thread_index string, thread_topic string, sender_name string, sender_email string, "
    "recipients_to array<string>, recipients_cc array<string>, recipients_bcc array<string>, "
    f"subject string, body string, sent_at timestamp, attachments array<{ATTACHMENT}>, error string"
)

# The five tables, in export order.
TABLES = {
    "messages": (
        "message_id bigint, external_id string, thread_id string, folder string, sender_name string, "
        "sender_email string, recipients_to array<string>, recipients_cc array<string>, "
        "recipients_bcc array<string>, subject string, body string, sent_at timestamp, "
        "received_at timestamp, is_read boolean, has_attachments boolean, account_tag string, "
        "partner_tags array<string>, raw_headers string"
    ),
    "attachments": "message_id bigint, filename string, content_type string, size_bytes bigint, content binary",
    "events": (
        "message_id bigint, kind string, title string, starts_at timestamp, ends_at timestamp, "
        "location string, extra string"
    ),
    "entities": "message_id bigint, label string, text string, start_char int, end_char int",
    "account_tags": "message_id bigint, tag string, kind string",
}

EMBEDDINGS = "message_id bigint, excerpt string, embedding array<float>"


def columns(ddl: str) -> list[str]:
    """Column names of one of the layouts above."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
