"""Everything below a root listed once, loose files and zip entries alike, and read from that list inside tasks.

No content is opened to make the list, and what is left out of it is never opened at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtables.functions.text import file_name
from mailtables.schema import RAW
from mailtables.sources import kinds, zips
from mailtables.sources.calendars import parse_events
from mailtables.sources.cutting import cut_records
from mailtables.sources.files import RAW_ARROW, list_files, mbox_payload, open_file

#: A file or entry that has to be read whole may have this many bytes; a larger one is an error of its own.
WHOLE_BYTES = 1 << 30
_TASK_BYTES = 64 << 20
_RANGE_BYTES = 64 << 20
_CHUNK = 1 << 20
_BATCH_BYTES = 16 << 20
_PLACE = ["archive", "path", "kind", "modified", "size_bytes", "header_offset", "packed_bytes", "method", "crc"]


def list_root(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size_bytes) of every loose file below `root`, archives included."""
    return list_files(spark, root)


def list_contents(files: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Loose files with the entries of the archives among them: where each lies, its kind, and why it cannot be read.

    `kind` is a mail kind, `zip`, `other` or null for a part or attachment without a kind of its own.
    """
    place = {c: F.lit(None).cast(t) for c, t in (
        ("archive", "string"), ("header_offset", "bigint"), ("packed_bytes", "bigint"), ("method", "int"),
        ("crc", "bigint"), ("error", "string"),
    )}
    loose = files.select("path", "modified", "size_bytes").withColumns(place)
    archives = files.where(F.col("path").rlike(kinds.ARCHIVE))
    entries = archives.select("path", "modified").mapInArrow(zips._list_entries, zips.LISTING)
    everything = loose.unionByName(entries.select(*loose.columns))
    kind = F.when(F.col("archive").isNull() & F.col("path").rlike(kinds.ARCHIVE), "zip").otherwise(kinds.mail_kind(F.col("path")))
    whole = ~F.coalesce(kind, F.lit("")).isin("mbox", "ics", "zip") & (F.col("size_bytes") > whole_bytes)
    too_large = F.concat(F.lit("larger than "), F.lit(str(whole_bytes)), F.lit(" bytes"))
    return everything.withColumn("kind", kind).withColumn(
        "error", F.coalesce("error", F.when(whole & (kind.isNotNull() | F.col("path").rlike(kinds.BODY_PART)), too_large))
    )


def _dealt(listing: DataFrame, key: list[str]) -> DataFrame:
    """Listed rows spread over as many tasks as the bytes they stand for; only the rows travel."""
    total = listing.agg(F.sum(F.coalesce("packed_bytes", "size_bytes"))).first()[0] or 0
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, math.ceil(total / _TASK_BYTES))
    return listing.repartition(tasks, *key).sortWithinPartitions(*key)


def read_whole(listing: DataFrame, kind: str) -> DataFrame:
    """Raw rows of listed files and entries, each read whole. One that cannot be read has `error`."""
    wanted = listing.where(F.col("error").isNull()).withColumn("kind", F.lit(kind)).select(*_PLACE)
    return _dealt(wanted, ["archive", "header_offset", "path"]).mapInArrow(_read_whole, RAW)


def read_mbox(listing: DataFrame) -> DataFrame:
    """Raw rows of the messages of listed mailboxes: loose files by ranges of bytes, entries as streams."""
    wanted = listing.where((F.col("kind") == "mbox") & F.col("error").isNull())
    ranges = _ranges(wanted).mapInArrow(_read_mbox_ranges, RAW)
    entries = wanted.where(F.col("archive").isNotNull()).select(*_PLACE)
    return ranges.unionByName(_dealt(entries, ["archive", "header_offset", "path"]).mapInArrow(_read_mbox_entries, RAW))


def read_events(listing: DataFrame) -> DataFrame:
    """Calendar events of listed files and entries, and `error` rows for those that cannot be read."""
    wanted = listing.where((F.col("kind") == "ics") & F.col("error").isNull())
    ranges = _ranges(wanted).mapInArrow(_read_ics_ranges, RAW)
    entries = read_whole(wanted.where(F.col("archive").isNotNull()), "ics")
    return ranges.unionByName(entries.mapInArrow(_cut_calendars, RAW))


def events_of(blocks: DataFrame) -> DataFrame:
    return parse_events(blocks.where(F.col("error").isNull()).select("path", "modified", F.col("content").cast("string").alias("block")))


def xml_files(listing: DataFrame) -> DataFrame:
    return listing.where((F.col("kind") == "xml") & (F.lower(file_name(F.col("path"))) != kinds.XML_SKIPPED))


def _ranges(listing: DataFrame) -> DataFrame:
    """Loose files as ranges of bytes; a record belongs to the range in which it starts."""
    loose = listing.where(F.col("archive").isNull())
    count = F.greatest(F.lit(1), F.ceil(F.col("size_bytes") / _RANGE_BYTES))
    ranges = loose.select(
        "path", "kind", "modified", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("at"), "size_bytes"
    ).select(
        "path", "kind", "modified", (F.col("at") * _RANGE_BYTES).alias("block"),
        ((F.col("at") + 1) * _RANGE_BYTES).alias("until"), F.least(F.lit(_RANGE_BYTES), "size_bytes").alias("packed_bytes"),
        "size_bytes",
    )
    return _dealt(ranges, ["path", "block"])


class _Rows:
    """Raw rows gathered into Arrow batches of bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, row: dict, **values) -> bool:
        full = {"block": 0, "ordinal": 0, "content": None, "error": None} | {
            n: row[n] for n in ("path", "kind", "modified")
        } | values
        self.rows.append(full)
        self.size += len(full["content"] or b"") + 200
        return self.size >= _BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, schema=RAW_ARROW)
        self.rows, self.size = [], 0
        return batch


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


class _Opened:
    """The file that the last row was in, kept open for the next row."""

    def __init__(self):
        self.name, self.file = None, None

    def get(self, name: str):
        if name != self.name:
            self.close()
            self.file = open_file(name)
            self.name = name
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def _read_rows(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
    """Rows that `read(row, opened)` yields as keyword values; what it raises becomes an error row."""
    out, opened = _Rows(), _Opened()
    try:
        for batch in batches:
            for row in batch.to_pylist():
                seen = 0
                try:
                    for values in read(row, opened):
                        seen += 1
                        if out.add(row, **values):
                            yield out.take()
                except Exception as error:
                    out.add(row, block=row.get("header_offset") or row.get("block") or 0, ordinal=seen, error=_reason(error))
        if out.rows:
            yield out.take()
    finally:
        opened.close()


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(row, opened):
        if row["archive"] is None:
            with open_file(row["path"]) as file:
                yield {"content": file.read()}
        else:
            content = b"".join(zips._unpacked(opened.get(row["archive"]), row))
            yield {"content": content, "block": row["header_offset"]}

    return _read_rows(batches, read)


def _pieces(file, start: int) -> Iterator[bytes]:
    file.seek(start)
    while piece := file.read(_CHUNK):
        yield piece


def _read_ranges(batches: Iterator[pa.RecordBatch], mark: bytes, shape) -> Iterator[pa.RecordBatch]:
    def read(row, opened):
        pieces = _pieces(opened.get(row["path"]), row["block"])
        records = cut_records(pieces, mark, row["until"] - row["block"], first=row["block"] == 0)
        for ordinal, content in enumerate(shape(records)):
            yield {"content": content, "block": row["block"], "ordinal": ordinal}

    return _read_rows(batches, read)


def _mailbox(records: Iterator[bytes]) -> Iterator[bytes]:
    """Payloads of records that are messages; text before the first message is none."""
    return (mbox_payload(record) for record in records if record.startswith(b"From "))


def _read_mbox_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _read_ranges(batches, b"\nFrom ", _mailbox)


def _read_ics_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _read_ranges(batches, b"\nBEGIN:VEVENT", iter)


def _read_mbox_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(row, opened):
        pieces = zips._unpacked(opened.get(row["archive"]), row)
        for ordinal, content in enumerate(_mailbox(cut_records(pieces, b"\nFrom "))):
            yield {"content": content, "block": row["header_offset"], "ordinal": ordinal}

    return _read_rows(batches, read)


def _cut_calendars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(row, opened):
        if row["error"] is not None:
            yield {"block": row["block"], "error": row["error"]}
        else:
            for ordinal, content in enumerate(cut_records(iter([row["content"]]), b"\nBEGIN:VEVENT")):
                yield {"content": content, "block": row["block"], "ordinal": ordinal}

    return _read_rows(batches, read)
