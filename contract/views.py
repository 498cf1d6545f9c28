"""The given tables seen as mail: messages, files and raw rows derived from them."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import contract
from mailtables.operators.tagging import Account, Rules
from mailtables.sources import files
from mailtables.session import configure, spread


def render_message(sender, to, subject, date, message_id, body, **headers):
    """A plain-text message as one text column; values must not contain line breaks in the headers."""
    fields = [("From", sender), ("To", to), ("Subject", subject), ("Date", date), ("Message-ID", message_id)]
    fields += [(name.replace("_", "-"), value) for name, value in headers.items()]
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))) for name, value in fields]
    fixed = "MIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
    return F.concat(F.concat_ws("", *lines), F.lit(fixed), body)


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; `heavy` says that much work per row follows, so a scan of few splits is spread out."""
    rows = configure(spark, contract).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if heavy else rows


#: Entries of one archive; zipfile keeps what it wrote in memory until the archive is closed.
ARCHIVE_ENTRIES = 20_000


def pack(rows: DataFrame, folder: str) -> None:
    """Write rows (path, content) into zip archives below `folder`, one per task and `ARCHIVE_ENTRIES`, named after its
    partition, so that a repeated task writes the same files again. Later archives of a task sort after its first."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = files.locate(folder)
        filesystem.create_dir(base, recursive=True)
        stream = archive = None
        count = 0
        for batch in batches:
            for row in batch.to_pylist():
                if archive is not None and count % ARCHIVE_ENTRIES == 0:
                    archive.close()
                    stream.close()
                    archive = None
                if archive is None:
                    later = f".zz{count // ARCHIVE_ENTRIES:09d}" if count else ""
                    stream = filesystem.open_output_stream(f"{base}/part-{row['part']}{later}.zip")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(row["path"], row["content"])
                count += 1
        if archive is not None:
            archive.close()
            stream.close()
        yield pa.RecordBatch.from_pydict({"done": [True]})

    _run(rows.withColumn("part", F.spark_partition_id()).mapInArrow(write, "done boolean"))


def write_file_per_task(rows: DataFrame, folder: str, ending: str) -> None:
    """Write the text rows (content) of each task as one file, under the same name each time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = files.locate(folder)
        filesystem.create_dir(base, recursive=True)
        stream = None
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    stream = filesystem.open_output_stream(f"{base}/part-{row['part']}{ending}")
                stream.write(row["content"].encode())
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_pydict({"done": [True]})

    _run(rows.withColumn("part", F.spark_partition_id()).mapInArrow(write, "done boolean"))


def _run(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def utc(column: str) -> Column:
    """The tables' zone-less times as UTC instants."""
    return F.col(column).cast("timestamp")


def bare(time: Column) -> Column:
    """A UTC instant as a zone-less time, the type the oracle returns."""
    return time.cast("timestamp_ntz")


def joined(values: str | Column) -> Column:
    return F.concat_ws(";", values)


def minute(column: str) -> Column:
    """A time that follows from an id: minutes since the start of 2024."""
    return F.timestamp_seconds(F.lit(1704067200) + F.col(column) * 60)


def conversation_mail(conversations: DataFrame) -> DataFrame:
    """Conversation turns as raw message rows: `block` is the conversation, `ordinal` the turn."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    message = render_message(
        sender=F.concat(F.col("role"), F.lit("@example.com")),
        to=F.lit("desk@example.org, Second Desk <desk2@example.org>"),
        subject=F.concat(F.lit("Conversation "), conv),
        date=F.concat(F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" +0000")),
        message_id=F.when(F.col("role") != "system", F.concat(F.lit("<"), conv, F.lit("."), turn, F.lit("@example.com>"))),
        body=F.col("text"),
        Cc=F.when(F.col("turn") % 2 == 1, F.lit("audit@example.org")),
        Thread_Topic=F.concat(F.lit("topic-"), conv),
    )
    return conversations.select(
        F.concat(F.lit("mail/"), conv, F.lit("/"), turn, F.lit(".eml")).alias("path"),
        F.lit("eml").alias("kind"),
        F.col("conv_id").alias("block"),
        F.col("turn").alias("ordinal"),
        at.alias("modified"),
        message.cast("binary").alias("content"),
    )


def customer_xml(spark, sf_dir):
    """An XML message per customer; those with a negative balance are malformed."""
    number = F.col("c_custkey").cast("string")
    address = F.concat(F.lit("c"), number, F.lit("@example.com"))
    content = F.concat(
        F.lit('<m:email xmlns:m="urn:mail"><m:OPFMessageCopySubject> '), F.col("c_name"),
        F.lit(" </m:OPFMessageCopySubject>"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<from>Sales &lt;"), address, F.lit("&gt;</from>")))
        .when(F.col("c_custkey") % 3 == 1,
              F.concat(F.lit("<from>Sales</from><emailAddress name='x' address='"), address, F.lit("'/>")))
        .otherwise(F.lit("<from>Sales</from>")),
        F.lit("<to>a@example.org; "), address, F.lit("</to><to>a@example.org</to>"),
        F.lit("<sent>2024-01-02T03:04:05+01:00</sent><Body>Segment "), F.col("c_mktsegment"), F.lit("</Body>"),
        F.when(F.col("c_acctbal") < 0, F.lit("</m:wrong>")).otherwise(F.lit("</m:email>")),
    )
    return table(spark, sf_dir, "customer", heavy=True).select(
        F.concat(F.lit("xml/"), number, F.lit("/message.xml")).alias("path"),
        F.lit(0).cast("timestamp").alias("modified"),
        content.cast("binary").alias("content"),
    )


def document_messages(documents: DataFrame) -> DataFrame:
    """Documents as messages, before tagging."""
    nobody = F.array().cast("array<string>")
    return documents.select(
        F.col("doc_id").alias("message_id"),
        F.concat(F.col("source"), F.lit(" in "), F.col("lang")).alias("subject"),
        F.col("text").alias("body"),
        F.concat(F.col("source"), F.lit("@"), F.col("lang"), F.lit(".example.com")).alias("sender_email"),
        F.array(F.concat(F.lit("Desk@"), F.col("source"), F.lit(".example.net"))).alias("recipients_to"),
        nobody.alias("recipients_cc"),
        nobody.alias("recipients_bcc"),
        minute("doc_id").alias("sent_at"),
        F.col("source").alias("account_tag"),
    )


# Rules over the words of the documents: domains decide alone, words need an alias and a keyword.
DOCUMENT_RULES = Rules(
    accounts=(
        Account("Thatin", ("thatin", "hehely"), ("de.example.com",), ("Ononst", "Orantion"), ("THING", "attion")),
        Account("Ononst", ("ononst",), ("src7.example.net",), ("Thatin",), ("thble", "ering")),
        Account("Nicht", ("nicht", "ensch"), ("fr.example.com", "es.example.com"), ("Erble", "Thatin"), ("enung",)),
        Account("Erble", ("erble",), ("src3.example.net",), ("Queci",), ("retion", "oning")),
    )
)

# Overrides over the pages: one sender, then two subject patterns of which the first that matches wins.
PAGE_RULES = Rules(
    accounts=(
        Account("Blogs", (), ("blog.example",), ("Feed",), ()),
        Account("Net", ("example.net",), (), ("Feed",), ("/en/",)),
    ),
    addresses={"page-7@example.com": "Seven", "page-11@example.com": "Eleven"},
    subjects=((r"(?i)SPAM.farm", "Spam"), (r"/en/\d+\.html", "English")),
)


def page_messages(pages: DataFrame) -> DataFrame:
    nobody = F.array().cast("array<string>")
    return pages.select(
        F.col("page_id").alias("message_id"),
        F.col("url").alias("subject"),
        F.when(F.contains("url", F.lit("utm_source")), "from a feed").alias("body"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("@example.com")).alias("sender_email"),
        F.when(F.contains("url", F.lit("//blog.")), F.array(F.lit("Editor@Blog.Example")))
        .otherwise(nobody).alias("recipients_to"),
        nobody.alias("recipients_cc"),
        nobody.alias("recipients_bcc"),
    )
