"""Folder scans: whole files, and mbox files split into messages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtables.schema import RAW

# The extensions of each kind. Hadoop globs are case-sensitive, so both cases are spelled out.
GLOBS = {
    "eml": "*.{[eE][mM][lL],[tT][xX][tT]}",
    "mbox": "*.[mM][bB][oO][xX]",
    "emlx": "*.[eE][mM][lL][xX]",
    "ics": "*.[iI][cC][sS]",
    "xml": "*.[xX][mM][lL]",
    "zip": "*.[zZ][iI][pP]",
    "part": "*.{[cC][oO][mM]_00[01][0-9],[hH][tT][mM][lL],[hH][tT][mM],[rR][tT][fF],[tT][xX][tT]}",
}

RAW_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("kind", pa.string()),
        ("block", pa.int64()),
        ("ordinal", pa.int64()),
        ("modified", pa.timestamp("us", tz="UTC")),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Spark path and the path's name in it."""
    uri = path.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        # Only scheme and host are parsed as a URI: Spark's paths are not percent-encoded.
        scheme, _, rest = uri.partition("://")
        host, _, name = rest.partition("/")
        try:
            filesystem, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        except (pa.ArrowException, OSError) as error:
            raise OSError(f"tasks cannot open {scheme}:// paths ({error}); see mailtables.sources.files.locate") from error
        return filesystem, f"{base.rstrip('/')}/{name}"
    return fs.LocalFileSystem(), uri


def open_file(path: str):
    """Open a file inside a task, for reading parts of it."""
    filesystem, name = locate(path)
    return filesystem.open_input_file(name)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, modification time and size of every file below `root`; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    )


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """`list_files` plus the content. Columns that are not used later are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), "content"
        )
    )


def scanned_path() -> Column:
    """The file of a text row, written as the binary file source writes paths: not percent-encoded."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:///", "file:/")


def as_raw(files: DataFrame, kind: str) -> DataFrame:
    """Whole files as raw message rows."""
    return files.select(
        "path",
        F.lit(kind).alias("kind"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("ordinal"),
        "modified",
        "content",
        F.lit(None).cast("string").alias("error"),
    )


def read_eml(spark: SparkSession, root: str) -> DataFrame:
    return as_raw(read_files(spark, root, GLOBS["eml"]), "eml")


def read_emlx(spark: SparkSession, root: str) -> DataFrame:
    return as_raw(read_files(spark, root, GLOBS["emlx"]), "emlx")


def read_mbox(spark: SparkSession, root: str, glob: str = GLOBS["mbox"]) -> DataFrame:
    """One row per message of every mbox file.

    The file is text whose rows end at a line that starts with `From `, so Spark splits a large mailbox over
    many tasks. `ordinal` counts within the split that starts at byte `block`;
    `mailtables.operators.ordinals.number_messages` turns the pair into the position in the file.
    """
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("lineSep", "\nFrom ")
        .text(root)
    )
    return mbox_rows(rows).mapInArrow(mbox_messages, RAW)


def mbox_rows(rows: DataFrame) -> DataFrame:
    """Text rows with the file and split they come from; the cast keeps 8-bit bytes as they are."""
    return rows.select(
        scanned_path().alias("path"),
        F.lit("mbox").alias("kind"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").cast("binary").alias("content"),
        F.lit(None).cast("string").alias("error"),
    )


def mbox_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each split and take the `From ` line off.

    Only the first row of a file still starts with `From `; without it that row is text before the first
    message.
    """
    split, seen = None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["path"], row["block"]) != split:
                split, seen = (row["path"], row["block"]), 0
                if row["block"] == 0 and not row["content"].startswith(b"From "):
                    seen = -1
            if seen >= 0:
                row["ordinal"] = seen
                row["content"] = mbox_payload(row["content"])
                out.append(row)
            seen += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=RAW_ARROW)


def mbox_payload(message: bytes) -> bytes:
    """The message after its `From ` line, without the blank line that ends it and one level of `>From ` quoting."""
    payload = message.partition(b"\n")[2]
    for ending in (b"\r\n", b"\n"):
        if payload.endswith(ending * 2):
            payload = payload[: -len(ending)]
            break
    return re.sub(rb"(?m)^>(>*From )", rb"\1", payload)
