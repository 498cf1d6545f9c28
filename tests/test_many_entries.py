"""Archives of many entries: listing and writing them takes no memory that grows with their number."""

import datetime
import io
import tracemalloc
import zipfile

import pyarrow as pa
import pytest

from contract import views
from mailtables.operators import vectors
from mailtables.sources import zips

AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def _listed(path):
    batch = pa.RecordBatch.from_pylist([{"path": str(path), "modified": AT}])
    return [row for found in zips._list_entries(iter([batch])) for row in found.to_pylist()]


def _archive(entries, ahead=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for i in range(entries):
            info = zipfile.ZipInfo(f"m/{i % 40}/é{'x' * (i % 70)}" + ("/" if i % 9 == 8 else ".eml"))
            info.comment = b"c" * (i % 5 * 30)
            archive.writestr(info, b"text %d" % i)
        archive.comment = b"about"
    return ahead + out.getvalue()


@pytest.mark.filterwarnings("ignore:Duplicate name")
@pytest.mark.parametrize("entries, ahead", [(1, b""), (400, b""), (400, b"before the archive")])
@pytest.mark.parametrize("piece", [1, 200, 4096, 256 << 10])
def test_entries_are_those_of_the_whole_directory(tmp_path, monkeypatch, entries, ahead, piece):
    monkeypatch.setattr(zips, "_DIRECTORY_BYTES", piece)
    path = tmp_path / "a.zip"
    path.write_bytes(_archive(entries, ahead))
    with zipfile.ZipFile(path) as archive:
        want = [
            (i.filename, i.file_size, i.header_offset, i.compress_size, i.compress_type, i.CRC)
            for i in archive.infolist() if not i.is_dir()
        ]
    columns = ("entry", "size_bytes", "header_offset", "packed_bytes", "method", "crc")
    assert [tuple(row[c] for c in columns) for row in _listed(path)] == want


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_broken_directory_is_one_error_row(tmp_path, monkeypatch):
    monkeypatch.setattr(zips, "_DIRECTORY_BYTES", 200)
    whole = _archive(300)
    last = whole.rindex(b"PK\x01\x02")
    for broken in (whole[:last] + b"XX" + whole[last + 2:], whole[:-40], b"", b"no archive"):
        path = tmp_path / "broken.zip"
        path.write_bytes(broken)
        rows = _listed(path)
        assert [row["entry"] for row in rows] == [None] and rows[0]["error"]
    path.write_bytes(whole[:last] + b"XX" + whole[last + 2:])
    with pytest.raises(zipfile.BadZipFile) as error:
        zipfile.ZipFile(path)
    assert _listed(path)[0]["error"] == f"BadZipFile: {error.value}"


def test_listing_memory_does_not_grow(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for i in range(20_000):
            archive.writestr(f"mail/{i}.eml", b"")
    batch = pa.RecordBatch.from_pylist([{"path": str(path), "modified": AT}])
    tracemalloc.start()
    try:
        assert sum(found.num_rows for found in zips._list_entries(iter([batch]))) == 20_000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 10 << 20  # all entries at once take more than 20 MB


def test_packed_archives_have_bounded_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "ARCHIVE_ENTRIES", 10)
    rows = spark.range(0, 25, 1, 1).selectExpr("'m/' || id AS path", "cast('text ' || id AS binary) AS content")
    views.pack(rows, str(tmp_path / "packed"))
    found = {}
    for path in sorted(p for p in (tmp_path / "packed").iterdir() if p.suffix == ".zip"):
        with zipfile.ZipFile(path) as archive:
            found[path.name] = [(name, archive.read(name)) for name in archive.namelist()]
    assert [len(entries) for entries in found.values()] == [10, 10, 5]
    assert list(found)[0] == "part-0.zip"
    assert sum(found.values(), []) == [(f"m/{i}", b"text %d" % i) for i in range(25)]


def test_remembered_words_are_bounded():
    encode = vectors.hashing_encoder(16)
    words = ["".join(chr(97 + n // 26 ** k % 26) for k in range(5)) for n in range(150_000)]
    alone = vectors.hashing_encoder(16)(words[-1:])
    assert (encode(words)[-1] == alone[0]).all()
    places = encode.__closure__[[c.__class__.__name__ for c in (x.cell_contents for x in encode.__closure__)].index("_Places")]
    assert len(places.cell_contents) <= 100_000
