import datetime as dt
import hashlib
import zipfile

from pyspark.sql import functions as F

import samples as S
from mailtables.operators.ordinals import number_messages
from mailtables.plans.messages import mail_records, parse_errors
from mailtables.sources import files, mime, zips


def utc(row_time):
    return row_time.replace(tzinfo=None)


def by_subject(parsed):
    return {row.subject: row for row in parsed.collect()}


def test_eml_folder(spark, write, tmp_path):
    write("a/plain.eml", S.PLAIN)
    write("a/b/UPPER.EML", S.NO_ZONE)
    write("a/b/bad.TXT", S.BAD_DATE)
    write("a/noid.eml", S.NO_ID)
    write("a/parts.eml", S.MULTIPART)
    write("a/html.eml", S.HTML_ONLY)
    write("a/cut.eml", S.TRUNCATED)
    write("a/other.pdf", b"%PDF")
    parsed = mime.parse_mime(files.read_eml(spark, str(tmp_path)))
    assert parsed.count() == 7 and parse_errors(parsed).count() == 0
    records = {row.external_id: row for row in mail_records(parsed).collect()}

    plain = records["<plain@example.com>"]
    assert plain.subject == "Café plans"
    assert plain.sender_email == plain.sender_name == "ann@example.com"
    assert plain.recipients_to == ["bo@acme.example", "cy@globex.example"]
    assert plain.recipients_cc == ["lf@example.org"] and plain.recipients_bcc == []
    assert utc(plain.sent_at) == dt.datetime(2024, 1, 2, 10)
    assert plain.thread_id == "plans"
    assert plain.body.startswith("Meet on") and plain.attachments == []

    assert utc(records["<naive@x>"].sent_at) == dt.datetime(2024, 1, 1, 10)
    assert records["<bad@x>"].sent_at is None
    hashed = hashlib.sha1(b"a@x.example" + b"no id").hexdigest()
    assert records[hashed].subject == "no id"

    multi = records["<multi@example.com>"]
    assert multi.sender_name == "Ann <ann@example.com>" and multi.sender_email == "ann@example.com"
    assert multi.body == "first café\n\nsecond"
    assert [(a.filename, a.content_type, a.size_bytes) for a in multi.attachments] == [
        ("report.pdf", "application/pdf", 5), ("notes.txt", "text/plain", 12)
    ]
    assert records["<html@example.com>"].body.split() == ["One", "&", "two", "three"]
    assert records["<cut@example.com>"].body.startswith("first café")


def test_unreadable_content_is_reported(spark):
    raw = spark.createDataFrame([("x", "eml", 0, 0, dt.datetime(2024, 1, 1), None, None)], files.RAW)
    parsed = mime.parse_mime(raw)
    assert mail_records(parsed).count() == 0
    assert parse_errors(parsed).first().error.startswith("ValueError")


def test_mbox(spark, write, tmp_path):
    write("box.mbox", S.MBOX)
    write("junk.MBOX", b"text before\n" + S.MBOX)
    parsed = mime.parse_mime(files.read_mbox(spark, str(tmp_path)))
    numbered = number_messages(parsed).orderBy("path", "position").collect()
    assert [row.position for row in numbered] == [0, 1, 2, 0, 1, 2]
    assert [row.subject for row in numbered][:3] == ["naive", "latin", "quoted"]
    assert numbered[1].body == "café\n"
    assert numbered[2].body == "From here on\n>From there\nFromage\n"


def test_large_mbox_is_split_without_loss(spark, write, tmp_path):
    one = "From a@x Mon Jan  1 00:00:00 2024\nSubject: {0}\nMessage-ID: <{0}@x>\n\n{1}\n\n"
    write("big.mbox", "".join(one.format(i, "x" * (1 + i * 7 % 900)) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        parsed = mime.parse_mime(files.read_mbox(spark, str(tmp_path)))
        rows = number_messages(parsed).select("position", "subject", "block", F.length("body").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({row.block for row in rows}) > 5
    assert sorted((row.position, int(row.subject), row.n) for row in rows) == [
        (i, i, i * 7 % 900 + 2) for i in range(3000)
    ]


def test_emlx(spark, write, tmp_path):
    write("m/1.emlx", S.EMLX)
    row = mime.parse_mime(files.read_emlx(spark, str(tmp_path))).first()
    assert (row.subject, row.body, row.id_header) == ("emlx", "payload\n", "<emlx@x>")


def test_zip(spark, write, tmp_path):
    with zipfile.ZipFile(tmp_path / "export.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("in/plain.eml", S.PLAIN)
        archive.writestr("in/deep/box.mbox", S.MBOX)
        archive.writestr(zipfile.ZipInfo("stored.eml"), S.NO_ID)
        archive.writestr("skipped.pdf", b"%PDF" * 1000)
    write("broken.zip", b"PK\x03\x04 nothing more")
    listing = zips.list_zip_entries(spark, str(tmp_path))
    rows = listing.collect()
    assert sorted(row.entry for row in rows if row.error is None) == [
        "in/deep/box.mbox", "in/plain.eml", "skipped.pdf", "stored.eml"
    ]
    assert [row.archive.split("/")[-1] for row in rows if row.error] == ["broken.zip"]
    mail = zips.read_zip_entries(listing.where("path like '%.eml'"), "eml").unionByName(
        zips.read_zip_entries(listing.where("path like '%.mbox'"), "mbox")
    )
    parsed = by_subject(mime.parse_mime(mail))
    assert set(parsed) == {"Café plans", "no id", "naive", "latin", "quoted"}
    assert parsed["latin"].ordinal == 1 and parsed["latin"].body == "café\n"
    assert parsed["quoted"].body == "From here on\n>From there\nFromage\n"


def test_damaged_zip_entry_is_reported(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("one.eml", S.PLAIN)
        archive.writestr("two.eml", S.NO_ID)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    spot = data.index(b"Meet on")
    data[spot] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(data))
    parsed = mime.parse_mime(zips.read_zip_entries(zips.list_zip_entries(spark, str(tmp_path)), "eml"))
    assert mail_records(parsed).count() == 1 and parse_errors(parsed).count() == 1
