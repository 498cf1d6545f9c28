"""Web archives: WARC files written as sorted capture runs, runs merged into capture histories, records read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailtables.llm.stored import lookup, saved
from mailtables.session import scratch_dir
from mailtables.sources.files import locate

REVISIT_BYTES = 100
ARCHIVE_BYTES = 128 << 20
MERGE_ROWS = 100_000
#: `pages` has no capture times. A page counts as captured so many seconds after this one as its page_id says.
FIRST_CAPTURE = 946684800
_READ = 1 << 20
_READ_TASKS = 100_000
_ORDER = ["url_key", "captured", "page_id", "file", "offset"]

_INDEX = pa.schema([
    ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("file", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()),
])
_INDEX_DDL = (
    "url_key string, captured bigint, page_id bigint, file string, offset bigint, length bigint, record_type string"
)
_RECORD_DDL = (
    "file string, offset bigint, page_id bigint, url string, captured bigint, record_type string, "
    "refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean, payload binary"
)


def url_key(url: Column) -> Column:
    """The host's labels in reverse, then the path and query: pages of one site sort side by side. Null has ''."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host == "", url).otherwise(F.concat(turned, F.lit(")"), rest))


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, captured, url_key, and refers_to: the page whose equal payload came first.

    Equal payloads of at least `least_bytes` bytes refer to the smallest page_id among them. Rows of that smallest id
    (several, if rows repeat), smaller payloads and rows without page_id refer to none. Only digests are grouped, in
    part before the shuffle; payloads are joined with the narrow list of revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = saved(
        pages.filter("page_id IS NOT NULL").select(
            "page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")
        ).filter(F.col("bytes") >= least_bytes),
        "warc-digests",
    )
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
    revisits = digests.join(firsts.filter("copies > 1"), "digest").filter("page_id > refers_to")
    # the digest stays in the key: a page_id that repeats may have other payloads as well
    revisits = saved(
        revisits.select(F.col("page_id").alias("revisit"), F.col("digest").alias("of"), "refers_to").distinct(),
        "warc-revisits",
    )
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    joined = rows.join(
        lookup(revisits, "of"), (F.col("page_id") == F.col("revisit")) & (F.col("digest") == F.col("of")), "left"
    )
    captured = F.lit(FIRST_CAPTURE) + F.coalesce(F.col("page_id"), F.lit(0))
    return joined.select(
        "page_id", "url", "payload", "digest", captured.cast("bigint").alias("captured"),
        url_key(F.col("url")).alias("url_key"), "refers_to",
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one or more archives per task below `folder`; returns their written index, a sorted run per archive.

    Each task sorts its captures by URL key and time, writes each as a gzip member of its own and starts a new archive
    at `archive_bytes`. File names carry the attempt, and only the attempt whose index rows are committed counts, so
    a task that runs again leaves no wrong entry.
    """
    rows = with_revisits(pages).sortWithinPartitions("url_key", "captured", "page_id")
    return saved(rows.mapInArrow(lambda batches: _write(batches, folder, archive_bytes), _INDEX_DDL), "warc-index")


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    filesystem, base = locate(folder)
    filesystem.create_dir(base, recursive=True)
    task = TaskContext.get()
    sink, name, offset, number = None, "", 0, 0
    try:
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if sink is None or offset >= archive_bytes:
                    if sink is not None:
                        sink.close()
                    name = f"run-{task.partitionId():05d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                    sink, offset, number = filesystem.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                member = gzip_member(render_record(row))
                sink.write(member)
                kind = "response" if row["refers_to"] is None else "revisit"
                index.append((row["url_key"], row["captured"], row["page_id"], name, offset, len(member), kind))
                offset += len(member)
            columns = list(zip(*index)) if index else [[]] * len(_INDEX)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX)], schema=_INDEX)
    finally:
        if sink is not None:
            sink.close()


def render_record(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, payload digest and length included, but no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {len(row['payload'])}\r\n\r\n"
    ).encode()
    block = http if row["refers_to"] is not None else http + row["payload"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {datetime.fromtimestamp(row['captured'], timezone.utc).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        # a header is one line: line ends in a URL are written as an agent would send them
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def merge_runs(index: DataFrame) -> DataFrame:
    """The runs of `index` merged into capture histories: its columns plus `position`, from 0, over all captures.

    Captures go by URL key, time, page and place. The key space is cut into ranges of about `MERGE_ROWS` captures, by
    the whole sort key, so a URL captured very often is cut too; each task merges its slices of all the runs.
    """
    parts = max(1, -(-index.count() // MERGE_ROWS))
    dealt = index.repartitionByRange(parts, *_ORDER).sortWithinPartitions("file", "offset")
    merged = dealt.mapInArrow(_merge, _INDEX_DDL).withColumn("place", F.monotonically_increasing_id())
    merged = saved(merged, "warc-merged")
    part = F.shiftright("place", 33)
    counts = merged.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(
        counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")), "warc-parts"
    )
    row = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return merged.withColumn("part", part).join(lookup(counts), "part").withColumn(
        "position", F.col("before") + row
    ).drop("part", "before", "place")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), _INDEX)
    if not table.num_rows:
        return
    # absent pages sort first, as Spark's range partitions have them
    names = ["url_key", "captured", "page_id", "file", "offset"]
    columns = [table[name].to_pylist() for name in names]
    columns[0] = [key.encode() for key in columns[0]]  # bytes order is Spark's order of strings
    columns[2] = [(page is not None, page or 0) for page in columns[2]]
    keys = list(zip(*columns))
    runs, start = [], 0
    for at in range(1, len(keys) + 1):
        if at == len(keys) or keys[at][3] != keys[start][3]:
            runs.append(range(start, at))
            start = at
    order = list(LoserTree([iter(run) for run in runs], keys.__getitem__))
    yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)


class LoserTree:
    """Merge sorted iterators: each inner node keeps the loser of its match, so one path is played again per item."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self._runs, self._key, self._count = runs, key, max(1, len(runs))
        self._items = [next(run, None) for run in runs] or [None]
        self._losers = [-1] * self._count
        self._winner = self._play(1) if self._count > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        """A run at its end loses to all others."""
        if self._items[a] is None or self._items[b] is None:
            return self._items[b] is None
        return self._key(self._items[a]) <= self._key(self._items[b])

    def _play(self, node: int) -> int:
        """Fill the losers below `node`; the leaves follow the inner nodes, run r is leaf count + r."""
        if node >= self._count:
            return node - self._count
        left, right = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(left, right):
            self._losers[node] = right
            return left
        self._losers[node] = left
        return right

    def __iter__(self) -> Iterator:
        while (item := self._items[self._winner]) is not None:
            yield item
            self._items[self._winner] = next(self._runs[self._winner], None)
            node, best = (self._winner + self._count) // 2, self._winner
            while node >= 1 and self._count > 1:
                if self._beats(self._losers[node], best):
                    self._losers[node], best = best, self._losers[node]
                node //= 2
            self._winner = best


def read_archives(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the named archives (`files`, column `file`), read from the front: one task reads one archive
    at a time, a record at a time.

    Columns: file, offset, page_id, url, captured, record_type, refers_to, payload_bytes and payload_digest (both of
    the full payload; a revisit's are those it carries), intact (a response's payload has the stated length and
    digest), payload (null for revisits and without `payloads`).
    """
    archives = files.select("file").distinct()
    tasks = min(_READ_TASKS, max(1, archives.count()))
    return archives.repartition(tasks, "file").mapInArrow(lambda batches: _read(batches, folder, payloads), _RECORD_DDL)


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    filesystem, base = locate(folder)
    names = [part.partition(" ")[0] for part in _RECORD_DDL.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, types[part.rpartition(" ")[2]]) for n, part in zip(names, _RECORD_DDL.split(", "))])
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows, held = [], 0
            with filesystem.open_input_stream(f"{base}/{name}", compression=None) as source:
                for offset, record in gzip_members(source):
                    rows.append({"file": name, "offset": offset, **parse_record(record, payloads)})
                    held += len(record) if payloads else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def gzip_members(source) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream, one in memory at a time."""
    rest, offset = source.read(_READ), 0
    while rest:
        unpacker, pieces, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest:
                raise ValueError(f"the archive ends inside the record at {offset}")
            pieces.append(unpacker.decompress(rest))
            used += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data if unpacker.eof else source.read(_READ)
        yield offset, b"".join(pieces)
        offset += used
        rest = rest or source.read(_READ)


def parse_record(record: bytes, payloads: bool = True) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    response = fields["WARC-Type"] == "response"
    when = datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    own = hashlib.sha256(payload).hexdigest() if response else None
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "captured": int(when.timestamp()),
        "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload_bytes": length,
        "payload_digest": own or digest, "intact": (len(payload) == length and own == digest) if response else None,
        "payload": payload if response and payloads else None,
    }


def archived(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write `pages` as archives in the shared folder, merge their runs and read every record back.

    The columns of `read_archives` plus `position`, the record's place among all capture histories. Null html is an
    empty payload; an empty table gives an empty result; other columns than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    index = write_archives(pages, folder)
    histories = merge_runs(index).select("file", "offset", "position")
    # written first: only a written table's size is known, and these rows may be many
    records = saved(read_archives(spark, folder, index, payloads), "warc-records")
    return records.join(histories, ["file", "offset"])
