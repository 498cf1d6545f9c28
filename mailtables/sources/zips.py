"""Zip archives read in place: a listing of entries, then their contents, spread over all tasks.

Only names and offsets are shuffled. A task opens an archive where it lies and reads just its own entries, so
neither a large archive nor one with many entries passes through a single task, and nothing is unpacked to disk.
"""

from __future__ import annotations

import io
import math
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtables.sources.cutting import cut_records
from mailtables.sources.files import GLOBS, RAW_ARROW, list_files, mbox_payload, open_file
from mailtables.schema import RAW

LISTING = (
    "archive string, entry string, path string, modified timestamp, size_bytes bigint, "
    "header_offset bigint, packed_bytes bigint, method int, crc bigint, error string"
)
_LISTING_ARROW = pa.schema(
    [
        ("archive", pa.string()),
        ("entry", pa.string()),
        ("path", pa.string()),
        ("modified", pa.timestamp("us", tz="UTC")),
        ("size_bytes", pa.int64()),
        ("header_offset", pa.int64()),
        ("packed_bytes", pa.int64()),
        ("method", pa.int32()),
        ("crc", pa.int64()),
        ("error", pa.string()),
    ]
)
_CHUNK = 1 << 20
#: Bytes of an archive's directory that are parsed at a time, some 3,000 entries.
_DIRECTORY_BYTES = 256 << 10
_BATCH_BYTES = 16 << 20
_TASK_BYTES = 64 << 20


def list_zip_entries(spark: SparkSession, root: str, glob: str = GLOBS["zip"]) -> DataFrame:
    """One row per file entry of every archive below `root`; a broken archive is one row with `error`."""
    return list_files(spark, root, glob).select("path", "modified").mapInArrow(_list_entries, LISTING)


def read_zip_entries(listing: DataFrame, kind: str | None = None) -> DataFrame:
    """The contents of listed entries as raw rows: one per entry, or one per message of an mbox entry.

    Filter the listing first; entries that are not wanted are then never read. Rows are dealt out by
    (archive, offset), a unique key, so that one archive may hold most of the entries. The number of tasks
    follows from the bytes they will read, as the few bytes that are shuffled say nothing about the work.
    """
    wanted = listing.where(F.col("error").isNull()).select(
        "archive", "path", (F.lit(kind) if kind else F.lit("file")).alias("kind"), "modified",
        "size_bytes", "header_offset", "packed_bytes", "method", "crc",
    )
    total = wanted.agg(F.sum("packed_bytes")).first()[0] or 0
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, math.ceil(total / _TASK_BYTES))
    spread = wanted.repartition(tasks, "archive", "header_offset")
    return spread.sortWithinPartitions("archive", "header_offset").mapInArrow(_read_entries, RAW)


def _directory(file) -> Iterator[list[zipfile.ZipInfo]]:
    """The entries of an archive in pieces of its directory, so that memory does not grow with their number.

    Each piece is parsed by `zipfile`, as the directory of an archive of its own.
    """
    try:
        end = zipfile._EndRecData(file)
    except OSError:
        end = None
    if not end:
        raise zipfile.BadZipFile("File is not a zip file")
    left, offset = end[zipfile._ECD_SIZE], end[zipfile._ECD_OFFSET]
    # what stands before the archive in its file
    ahead = end[zipfile._ECD_LOCATION] - left - offset
    if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:
        ahead -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
    if offset + ahead < 0:
        raise zipfile.BadZipFile("Bad offset for central directory")
    file.seek(offset + ahead)
    data = b""
    while left > 0:
        piece = file.read(min(_DIRECTORY_BYTES, left))
        if not piece:
            raise zipfile.BadZipFile("Truncated central directory")
        left -= len(piece)
        data += piece
        used = count = 0
        while used + zipfile.sizeCentralDir <= len(data):
            # names, extra fields and comments follow an entry's fixed part; a last one cut short is left to zipfile
            after = used + zipfile.sizeCentralDir + sum(struct.unpack_from("<3H", data, used + 28))
            if after > len(data) and left > 0:
                break
            used, count = min(after, len(data)), count + 1
        if left <= 0 and used < len(data):
            raise zipfile.BadZipFile("Truncated central directory")
        if not count:
            continue
        own_end = struct.pack(zipfile.structEndArchive, zipfile.stringEndArchive, 0, 0, count, count, used, 0, 0)
        with zipfile.ZipFile(io.BytesIO(data[:used] + own_end)) as part:
            entries = part.infolist()
        for info in entries:
            info.header_offset += ahead
        yield entries
        data = data[used:]


def _list_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = dict.fromkeys(_LISTING_ARROW.names)
    for batch in batches:
        for row in batch.to_pylist():
            archive = row["path"]
            base = empty | {"archive": archive, "path": archive, "modified": row["modified"]}
            try:
                with open_file(archive) as file:
                    # a broken directory is one error row without entries, so all of it is parsed before any row leaves
                    for _ in _directory(file):
                        pass
                    for entries in _directory(file):
                        yield pa.RecordBatch.from_pylist([
                            base | {
                                "entry": info.filename, "path": f"{archive}!/{info.filename}",
                                "size_bytes": info.file_size, "header_offset": info.header_offset,
                                "packed_bytes": info.compress_size, "method": info.compress_type,
                                "crc": info.CRC,
                            }
                            for info in entries if not info.is_dir()
                        ], schema=_LISTING_ARROW)
            except Exception as error:
                failed = base | {"error": f"{type(error).__name__}: {error}"}
                yield pa.RecordBatch.from_pylist([failed], schema=_LISTING_ARROW)


def _unpacked(file, row: dict) -> Iterator[bytes]:
    """The bytes of one entry, in pieces. Stored and deflated entries are what mail exports contain."""
    file.seek(row["header_offset"])
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no entry at the listed offset")
    name_size, extra_size = struct.unpack("<HH", head[26:30])
    file.seek(row["header_offset"] + 30 + name_size + extra_size)
    if row["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"zip method {row['method']}")
    inflate = zlib.decompressobj(-15) if row["method"] == zipfile.ZIP_DEFLATED else None
    left, crc = row["packed_bytes"], 0
    while left > 0:
        packed = file.read(min(_CHUNK, left))
        if not packed:
            raise zipfile.BadZipFile("entry ends early")
        left -= len(packed)
        piece = inflate.decompress(packed) if inflate else packed
        crc = zlib.crc32(piece, crc)
        yield piece
    if inflate:
        piece = inflate.flush()
        crc = zlib.crc32(piece, crc)
        yield piece
    if crc != row["crc"]:
        raise zipfile.BadZipFile("bad checksum")


def _read_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, file = None, None
    out, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["archive"] != name:
                if file is not None:
                    file.close()
                name, file = row["archive"], open_file(row["archive"])
            # two entries may share a name, so the offset is what tells their rows apart
            base = {"path": row["path"], "kind": row["kind"], "block": row["header_offset"], "ordinal": 0,
                    "modified": row["modified"], "content": None, "error": None}
            ordinal = -1
            try:
                if row["kind"] == "mbox":
                    records = cut_records(_unpacked(file, row), b"\nFrom ")
                    contents = (mbox_payload(record) for record in records if record.startswith(b"From "))
                else:
                    contents = iter([b"".join(_unpacked(file, row))])
                for ordinal, content in enumerate(contents):
                    out.append(base | {"ordinal": ordinal, "content": content})
                    size += len(content)
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=RAW_ARROW)
                        out, size = [], 0
            except Exception as error:
                # What came before the damage stands; the row after it has the reason.
                out.append(base | {"ordinal": ordinal + 1, "error": f"{type(error).__name__}: {error}"})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=RAW_ARROW)
    if file is not None:
        file.close()
