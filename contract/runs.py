"""Registered queries that write mail files from the given tables and ingest them, batch by batch or as a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from contract.views import bare, conversation_mail, customer_xml, pack, table, write_file_per_task
from mailtables.operators import entities, vectors
from mailtables.plans import ingest
from mailtables.schema import ENTITY
from mailtables.session import scratch_dir
from mailtables.sinks import tables
from mailtables.sources import mime
from mailtables.sources.sidecar import read_sidecar
from mailtables.streaming import incremental

NO_RULES = {"accounts": []}
SEMANTIC = {"accounts": [], "semantic": {"enabled": True}}


def _encoder():
    return vectors.hashing_encoder(16)


def _mail(spark, sf_dir, condition):
    return conversation_mail(table(spark, sf_dir, "conversations", heavy=True).where(condition)).select("path", "content")


def incremental_ingest(spark, sf_dir):
    """Conversation mail of two days in archives of one root; the second day repeats messages of the first."""
    root, store = scratch_dir(spark, "days"), scratch_dir(spark, "days-store")
    for day, condition in (("one", "turn <= 1"), ("two", "turn >= 1")):
        pack(_mail(spark, sf_dir, condition), f"{root}/{day}")
        ingest.ingest(spark, root, store, NO_RULES, day)
    return tables.read_table(spark, store, "messages", keep_batch=True).select("external_id", "batch")


def ingest_errors(spark, sf_dir):
    """Archives of customers' XML messages, some malformed, and of category lists, which are no messages."""
    root, store = scratch_dir(spark, "broken"), scratch_dir(spark, "broken-store")
    xml = customer_xml(spark, sf_dir).select("path", "content")
    lists = xml.select(F.replace("path", F.lit("message"), F.lit("Categories")).alias("path"), F.lit(b"<no list").alias("content"))
    pack(xml, f"{root}/messages")
    pack(lists, f"{root}/lists")
    ingest.ingest(spark, root, store, NO_RULES, "one")
    number = F.regexp_extract("path", r"xml/(\d+)/message\.xml$", 1).cast("bigint")
    return tables.read_table(spark, store, "errors").select(number.alias("c_custkey"), "stage")


def event_batches(spark, sf_dir):
    """Calendars ingested, written again and ingested again: each event stays one event."""
    root, store = scratch_dir(spark, "calendars"), scratch_dir(spark, "calendars-store")
    event = F.concat(
        F.lit("BEGIN:VEVENT\nDTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z\nSUMMARY:"), F.col("event_id"),
        F.lit("\nLOCATION:"), F.col("props"), F.lit("\nEND:VEVENT\n"),
    )
    rows = table(spark, sf_dir, "events", heavy=True).select(event.alias("content"))
    for batch in ("one", "two"):
        write_file_per_task(rows, root, ".ics")
        ingest.ingest(spark, root, store, NO_RULES, batch)
    found = tables.read_table(spark, store, "events")
    return found.select(F.col("title").cast("bigint").alias("event_id"), bare(F.col("starts_at")).alias("starts_at"), "location")


def emlx_attachments(spark, sf_dir):
    """Multipart emlx files with encoded headers and an inline attachment, read from archives."""
    root, store = scratch_dir(spark, "emlx"), scratch_dir(spark, "emlx-store")
    number = F.col("doc_id").cast("string")
    subject = F.concat("source", F.lit(" in "), "lang", F.lit(" \u00e9t\u00e9"))
    message = F.concat(
        F.lit("From: =?utf-8?q?J=C3=BCrgen?= <j@x.example>\nSubject: =?utf-8?b?"), F.base64(subject.cast("binary")),
        F.lit("?=\nMessage-ID: <d"), number, F.lit("@x>\nMIME-Version: 1.0\n"
              'Content-Type: multipart/mixed; boundary="CUT"\n\n--CUT\nContent-Type: text/plain; charset=utf-8\n'
              "Content-Transfer-Encoding: base64\n\n"), F.base64(F.col("text").cast("binary")),
        F.lit('\n--CUT\nContent-Type: application/pdf; name="d.pdf"\nContent-Disposition: inline; filename="d'), number,
        F.lit('.pdf"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.col("lang").cast("binary")), F.lit("\n--CUT--\n"),
    )
    file = F.concat(F.octet_length(message).cast("string"), F.lit("\n"), message, F.lit("<plist/>"))
    rows = table(spark, sf_dir, "documents", heavy=True).select(
        F.concat(F.lit("m/"), number, F.lit(".emlx")).alias("path"), file.cast("binary").alias("content")
    )
    pack(rows, root)
    ingest.ingest(spark, root, store, NO_RULES, "one")
    attached = tables.read_table(spark, store, "attachments").drop("content")
    messages = tables.read_table(spark, store, "messages").select(
        "message_id", F.regexp_extract("external_id", r"^<d(\d+)@x>$", 1).cast("bigint").alias("doc_id"), "sender_name",
        "subject", "body", "has_attachments",
    )
    return messages.join(attached, "message_id", "left").drop("message_id")


def stream_days(spark, sf_dir):
    """Two days of archives read as a stream with embeddings; the second day repeats the first one's messages."""
    root, store, checkpoint = (scratch_dir(spark, f"stream-{part}") for part in ("in", "store", "checkpoint"))
    for day, condition in (("one", "turn = 0"), ("two", "turn >= 0")):
        pack(_mail(spark, sf_dir, condition), f"{root}/{day}")
        incremental.run_mail(spark, root, store, checkpoint, SEMANTIC, make_encoder=_encoder)
    messages = tables.read_table(spark, store, "messages", keep_batch=True).select("message_id", "external_id", "batch")
    embedded = tables.read_table(spark, store, "embeddings").select("message_id", "excerpt", F.size("embedding").alias("dims"))
    return messages.join(embedded, "message_id", "left").drop("message_id")


def embeddings_store(spark, sf_dir):
    """Embeddings of conversation mail stored with the feature on and off, and a sidecar file read back."""
    parsed = mime.parse_mime(conversation_mail(table(spark, sf_dir, "conversations", heavy=True)))
    found = None
    for name, config in (("on", SEMANTIC), ("off", NO_RULES)):
        store = scratch_dir(spark, f"embeddings-{name}")
        staged = f"{store}/staged/batch=one"
        ingest.stage(parsed, None, None, staged)
        ingest.store_batch(spark, staged, store, config, "one", make_encoder=_encoder)
        rows = tables.read_table(spark, store, "embeddings").select("message_id", F.lit(name).alias("feature"))
        rows = rows.join(tables.read_table(spark, store, "messages").select("message_id", "external_id"), "message_id")
        if found is None:
            sidecar = scratch_dir(spark, "sidecar")
            tables.read_table(spark, store, "embeddings").select("message_id", "excerpt").write.json(sidecar)
            found = rows.join(read_sidecar(spark, sidecar), "message_id")
        else:
            found = found.unionByName(rows.withColumn("excerpt", F.lit(None).cast("string")))
    return found.drop("message_id")


def _head_entities(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda text: [{"label": "HEAD", "text": text[:5], "start_char": 0, "end_char": len(text[:5])}] if text else []
    )


def model_entities(spark, sf_dir):
    """Entities from the model hook beside the patterns' own."""
    documents = table(spark, sf_dir, "documents", heavy=True).select(F.col("doc_id").alias("message_id"), F.col("text").alias("body"))
    rows = entities.entity_rows(entities.add_entities(documents, "body", F.pandas_udf(_head_entities, f"array<{ENTITY}>")))
    return rows.where("label = 'HEAD'").withColumnRenamed("message_id", "doc_id")


RUNS = {
    "incremental_ingest": incremental_ingest,
    "ingest_errors": ingest_errors,
    "event_batches": event_batches,
    "emlx_attachments": emlx_attachments,
    "stream_days": stream_days,
    "embeddings_store": embeddings_store,
    "model_entities": model_entities,
}
