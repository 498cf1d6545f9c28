import csv
import datetime as dt
import os
import zipfile

import pytest
import yaml

import samples as S
from mailtables.operators.vectors import hashing_encoder
from mailtables.plans import ingest
from mailtables.schema import TABLES, columns
from mailtables.sinks import csv_export, tables
from mailtables.sources import report
from mailtables.sources.sidecar import read_sidecar
from mailtables.streaming import incremental

CONFIG = yaml.safe_load(S.RULES)


def read(spark, store, table):
    return tables.read_table(spark, store, table)


encoder = lambda: hashing_encoder(16)  # noqa: E731  (a lambda travels to the workers by value)


@pytest.fixture
def archive(write):
    write("in/plain.eml", S.PLAIN)
    write("in/sub/parts.eml", S.MULTIPART)
    write("in/sub/copy.eml", S.PLAIN)
    write("in/My Mail+/50% box.mbox", S.MBOX)
    write("in/My Mail+/one.emlx", S.EMLX)
    write("in/My Mail+/cal 1.ics", S.CALENDAR)


def test_a_new_store_has_the_five_tables(spark, tmp_path):
    store = str(tmp_path / "store")
    for table, layout in TABLES.items():
        df = read(spark, store, table)
        assert df.columns == columns(layout) and df.count() == 0
    assert {r.table_name for r in tables.table_counts(spark, store).collect()} == {
        "messages", "attachments", "events", "entities", "account_tags"
    }


def test_ingest_fills_all_tables(spark, archive, tmp_path):
    store = str(tmp_path / "store")
    ingest.ingest(spark, str(tmp_path / "in"), store, CONFIG, "one", make_encoder=encoder)
    assert {r.table_name: r.row_count for r in tables.table_counts(spark, store).collect()} == {
        "messages": 6, "attachments": 2, "events": 3, "entities": 3, "account_tags": 2
    }
    plain = read(spark, store, "messages").where("external_id = '<plain@example.com>'").first()
    assert plain.account_tag == "Acme" and plain.partner_tags == [] and plain.is_read is False
    assert plain.received_at == plain.sent_at == dt.datetime(2024, 1, 2, 10)
    entities = read(spark, store, "entities").where(f"message_id = {plain.message_id}").collect()
    assert sorted((e.label, plain.body[e.start_char:e.end_char]) for e in entities) == [
        ("DATE", "2024-01-05"), ("EMAIL", "bo@acme.example"), ("MONEY", "$1,250.00")
    ]
    embedded = read(spark, store, "embeddings")
    assert embedded.count() == 6 and embedded.where("excerpt like 'Café plans%'").count() == 1


@pytest.mark.parametrize("duplicates", ["replace", "skip"])
def test_ingest_again_reads_only_new_input(spark, archive, write, tmp_path, duplicates):
    store, root = str(tmp_path / "store"), str(tmp_path / "in")
    ingest.ingest(spark, root, store, CONFIG, "one", make_encoder=encoder)
    before = read(spark, store, "messages").count()
    write("in/new.eml", S.HTML_ONLY)
    changed = S.PLAIN.replace(b"Meet", b"Changed").replace(b"2024-01-05", b"2024-01-06 or 2024-01-07")
    write("in/zagain.eml", changed)
    for _ in range(2):  # the second time the batch is there already
        ingest.ingest(spark, root, store, CONFIG, "two", make_encoder=encoder, duplicates=duplicates)
    after = read(spark, store, "messages")
    assert after.count() == before + 1 == read(spark, store, "embeddings").count()
    kept = after.where("external_id = '<plain@example.com>'").collect()
    assert [row.body.split()[0] for row in kept] == ["Changed" if duplicates == "replace" else "Meet"]
    dates = read(spark, store, "entities").where(f"message_id = {kept[0].message_id} and label = 'DATE'").collect()
    assert sorted(r.text for r in dates) == (
        ["2024-01-06", "2024-01-07"] if duplicates == "replace" else ["2024-01-05"]
    )
    assert spark.read.parquet(f"{store}/staged/batch=two/parsed").count() == 2
    assert read(spark, store, "events").count() == 3
    assert read(spark, store, "account_tags").count() == 2


def test_an_uncommitted_batch_is_invisible_and_is_replaced(spark, archive, tmp_path, monkeypatch):
    store, root = str(tmp_path / "store"), str(tmp_path / "in")
    with monkeypatch.context() as patch:
        patch.setattr(tables, "commit", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ingest.ingest(spark, root, store, CONFIG, "one")
    assert read(spark, store, "messages").count() == 0
    ingest.ingest(spark, root, store, CONFIG, "one")
    assert read(spark, store, "messages").count() == 6


def test_zipped_export_gives_the_same_tables(spark, archive, tmp_path):
    os.mkdir(tmp_path / "zips")
    with zipfile.ZipFile(tmp_path / "zips" / "export.zip", "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, names in os.walk(tmp_path / "in"):
            for name in names:
                path = os.path.join(folder, name)
                packed.write(path, os.path.relpath(path, tmp_path))
    plain_store, zip_store = str(tmp_path / "a"), str(tmp_path / "b")
    ingest.ingest(spark, str(tmp_path / "in"), plain_store, CONFIG, "one")
    ingest.ingest(spark, str(tmp_path / "zips"), zip_store, CONFIG, "one")
    for table in TABLES:
        a, b = (sorted(map(repr, read(spark, s, table).collect())) for s in (plain_store, zip_store))
        assert a == b, table


def test_xml_beside_mail(spark, write, tmp_path):
    write("x/m/message.xml", "<r><subject>Acme contract</subject><from>a@acme.example</from></r>")
    write("x/m/p.html", "<html><p>Globex invoice on 2024-01-05</p></html>")
    write("x/m/com.microsoft.__Attachments/a.pdf", "12345")
    store = str(tmp_path / "store")
    ingest.ingest(spark, str(tmp_path / "x"), store, CONFIG, "one", xml="fallback")
    row = read(spark, store, "messages").first()
    assert (row.body, row.account_tag, row.partner_tags) == ("Globex invoice on 2024-01-05", "Acme", ["Globex"])
    assert row.has_attachments and read(spark, store, "attachments").first().size_bytes == 5
    assert read(spark, store, "entities").first().text == "2024-01-05"
    write("x/mail.eml", S.PLAIN)
    for xml, subjects in (("fallback", {"Café plans"}), ("never", {"Café plans"}), ("always", {"Café plans", "Acme contract"})):
        other = str(tmp_path / xml)
        ingest.ingest(spark, str(tmp_path / "x"), other, CONFIG, "one", xml=xml)
        assert {r.subject for r in read(spark, other, "messages").collect()} == subjects


def test_nothing_is_cut_by_default(spark, write, tmp_path):
    write("in/m/message.xml", "<r><subject>large</subject></r>")
    write("in/m/a.com_0001", "x" * 250_000)
    write("in/m/b.html", "<html><p>" + "y" * 20_000 + "</p></html>")
    for number in range(11):
        write(f"in/m/com.microsoft.__Attachments/{number:02}.pdf", "1")
    write("in/readme.txt", S.NO_ID)
    with zipfile.ZipFile(tmp_path / "in" / "more.zip", "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr("deep/plain.eml", S.PLAIN)
        packed.writestr("deep/n/other.xml", "<r><subject>zipped</subject><body>b</body></r>")
    write("in/paper.pdf", b"%PDF")
    store = str(tmp_path / "store")
    ingest.ingest(spark, str(tmp_path / "in"), store, CONFIG, "one", make_encoder=encoder)
    rows = {r.subject: r for r in read(spark, store, "messages").collect()}
    assert set(rows) == {"large", "no id", "Café plans", "zipped"}
    assert rows["large"].body == "x" * 250_000 + "\n\n" + "y" * 20_000
    assert read(spark, store, "attachments").where(f"message_id = {rows['large'].message_id}").count() == 11
    assert read(spark, store, "embeddings").where("length(excerpt) > 260000").count() == 1
    cut = str(tmp_path / "cut")
    limits = ingest.Limits(part_bytes=200_000, body_chars=10_000, attachment_names=10, excerpt_chars=2000)
    ingest.ingest(spark, str(tmp_path / "in"), cut, CONFIG, "one", make_encoder=encoder, limits=limits)
    large = read(spark, cut, "messages").where("subject = 'large'").first()
    assert large.body == "x" * 10_000
    assert read(spark, cut, "attachments").where(f"message_id = {large.message_id}").count() == 10
    assert read(spark, cut, "embeddings").where("length(excerpt) > 2000").count() == 0
    assert read(spark, store, "errors").count() == 0


def test_what_cannot_be_read_is_listed(spark, write, tmp_path):
    write("in/good.eml", S.PLAIN)
    write("in/large.eml", S.HTML_ONLY + b"x" * 5000)
    write("in/broken.zip", b"PK\x03\x04 nothing more")
    write("in/bad.xml", "<root><from>")
    write("in/blank.xml", "<root><from>a@b.example</from></root>")
    write("in/none.ics", "BEGIN:VCALENDAR\nEND:VCALENDAR\n")
    one = b"From a@x Mon Jan  1 00:00:00 2024\nSubject: %d\nMessage-ID: <%d@z>\n\nbody\n\n"
    with zipfile.ZipFile(tmp_path / "in" / "box.zip", "w") as packed:
        packed.writestr("box.mbox", b"".join(one % (i, i) for i in range(8)))
    data = bytearray((tmp_path / "in" / "box.zip").read_bytes())
    data[data.index(b"Subject: 7") + 9] ^= 1
    (tmp_path / "in" / "box.zip").write_bytes(bytes(data))
    store = str(tmp_path / "store")
    ingest.ingest(spark, str(tmp_path / "in"), store, CONFIG, "one", whole_bytes=5000)
    errors = {(r.path.split("/")[-1], r.stage): r.reason for r in read(spark, store, "errors").collect()}
    assert set(errors) == {("large.eml", "listing"), ("broken.zip", "listing"), ("bad.xml", "xml"), ("box.mbox", "mail")}
    assert errors["box.mbox", "mail"].startswith("ValueError: BadZipFile")
    known = {r.path.split("/")[-1] for r in read(spark, store, "inputs").collect()}
    assert known >= {"good.eml", "large.eml", "broken.zip", "bad.xml", "blank.xml", "none.ics", "box.zip"}
    ingest.ingest(spark, str(tmp_path / "in"), store, CONFIG, "two")
    assert read(spark, store, "errors").count() == 4 and spark.read.parquet(f"{store}/staged/batch=two/listing").count() == 0


def test_known_files_are_not_opened_again(spark, write, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "in")
    path = write("in/first.eml", S.PLAIN)
    box = write("in/box.mbox", S.MBOX)
    ingest.ingest(spark, root, store, CONFIG, "one")
    write("in/new.eml", S.HTML_ONLY)
    path.chmod(0)
    box.chmod(0)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    try:
        ingest.ingest(spark, root, store, CONFIG, "two")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert read(spark, store, "messages").count() == 5
    assert [r.path.split("/")[-1] for r in spark.read.parquet(f"{store}/staged/batch=two/listing").collect()] == ["new.eml"]


def test_one_row_per_id_and_event(spark, write, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "in")
    os.mkdir(tmp_path / "in")
    message = b"Message-ID: <7@x>\nSubject: s\n\n%s\n"
    with zipfile.ZipFile(tmp_path / "in" / "twice.zip", "w") as packed:
        with pytest.warns(UserWarning):
            packed.writestr("same.eml", message % b"one")
            packed.writestr("same.eml", message % b"two")
    cal = write("in/cal.ics", S.CALENDAR)
    ingest.ingest(spark, root, store, CONFIG, "one")
    assert [r.body for r in read(spark, store, "messages").collect()] == ["two\n"]
    before = sorted(map(repr, read(spark, store, "events").collect()))
    os.utime(cal, (1_800_000_000, 1_800_000_000))
    ingest.ingest(spark, root, store, CONFIG, "two")
    assert sorted(map(repr, read(spark, store, "events").collect())) == before
    cal.write_text("BEGIN:VCALENDAR\nEND:VCALENDAR\n")
    os.utime(cal, (1_900_000_000, 1_900_000_000))
    ingest.ingest(spark, root, store, CONFIG, "three")
    assert read(spark, store, "events").count() == 0


def test_csv_export(spark, archive, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    ingest.ingest(spark, str(tmp_path / "in"), store, CONFIG, "one")
    csv_export.export_tables(spark, store, out)
    for table, layout in TABLES.items():
        rows = []
        for name in os.listdir(f"{out}/{table}.csv"):
            if name.endswith(".csv"):
                with open(f"{out}/{table}.csv/{name}", newline="", encoding="utf-8") as file:
                    rows += csv.DictReader(file)
        assert len(rows) == read(spark, store, table).count()
        assert all(list(row) == columns(layout) for row in rows)
        if table == "messages":
            plain = next(row for row in rows if row["external_id"] == "<plain@example.com>")
            assert plain["recipients_to"] == "bo@acme.example;cy@globex.example"
            assert plain["sent_at"] == "2024-01-02T10:00:00Z" and plain["is_read"] == "0"
    csv_export.write_csv(read(spark, str(tmp_path / "none"), "entities"), f"{out}/empty.csv")
    text = "".join(
        (tmp_path / "out" / "empty.csv" / n).read_text() for n in os.listdir(f"{out}/empty.csv") if n.endswith(".csv")
    )
    assert text.strip() == "message_id,label,text,start_char,end_char"


def test_stream_reads_new_files_once(spark, write, tmp_path):
    store, root, checkpoint = str(tmp_path / "store"), str(tmp_path / "in"), str(tmp_path / "check")
    write("in/day1/plain.eml", S.PLAIN)
    write("in/day1/box.mbox", S.MBOX)
    incremental.run_mail(spark, root, store, checkpoint, CONFIG)
    assert read(spark, store, "messages").count() == 4
    write("in/day2/plain.eml", S.PLAIN.replace(b"Meet", b"Changed"))
    write("in/day2/one.emlx", S.EMLX)
    write("in/day2/html.eml", S.HTML_ONLY)
    incremental.run_mail(spark, root, store, checkpoint, CONFIG)
    after = read(spark, store, "messages")
    assert after.count() == 6 and after.where("body like 'Changed%'").count() == 0
    assert tables.committed(spark, store) == ["mail-0", "mail-1"]
    assert spark.read.parquet(f"{store}/staged/batch=mail-1/parsed").count() == 3
    incremental.run_mail(spark, root, store, checkpoint, CONFIG)
    assert tables.committed(spark, store) == ["mail-0", "mail-1"]
    write("in/day3/m/message.xml", "<r><subject>late</subject><body>b</body></r>")
    write("in/day3/cal.ics", S.CALENDAR)
    with zipfile.ZipFile(tmp_path / "in" / "day3" / "more.zip", "w") as packed:
        packed.writestr("n.eml", S.NO_ZONE.replace(b"<naive@x>", b"<zipped@x>"))
    incremental.run_mail(spark, root, store, checkpoint, CONFIG, make_encoder=encoder)
    assert read(spark, store, "messages").count() == 8 and read(spark, store, "events").count() == 3
    assert read(spark, store, "embeddings").count() == 2


def test_compaction_keeps_every_row(spark, archive, write, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "in")
    ingest.ingest(spark, root, store, CONFIG, "one", make_encoder=encoder)
    write("in/zagain.eml", S.PLAIN.replace(b"Meet", b"Changed"))
    write("in/bad.xml", "<root>")
    ingest.ingest(spark, root, store, CONFIG, "two", make_encoder=encoder)
    names = [*TABLES, "embeddings", "inputs", "errors"]
    before = {t: sorted(map(repr, read(spark, store, t).collect())) for t in names}
    for _ in range(2):
        tables.compact(spark, store, "merged-1")
    assert tables.committed(spark, store) == ["merged-1"]
    assert {t: sorted(map(repr, read(spark, store, t).collect())) for t in names} == before
    ingest.ingest(spark, root, store, CONFIG, "two")  # merged, so done already
    write("in/zzagain.eml", S.PLAIN.replace(b"Meet", b"Third"))
    ingest.ingest(spark, root, store, CONFIG, "three", make_encoder=encoder)
    assert tables.committed(spark, store) == ["merged-1", "three"]
    assert [r.body.split()[0] for r in read(spark, store, "messages").where("external_id = '<plain@example.com>'").collect()] == ["Third"]
    assert read(spark, store, "events").count() == 3


def test_source_report_and_sidecar(spark, archive, write, tmp_path):
    write("in/renamed", b"PK\x03\x04rest")
    write("in/mail.pst", b"!BDN")
    write("in/export.olm", b"PK\x03\x04")
    write("in/hidden", b"!BDN")
    write("in/what.bin", b"??")
    kinds = {r.path.split("/")[-1]: r.source_kind for r in report.source_report(spark, str(tmp_path / "in")).collect()}
    assert kinds["renamed"] == "zip" and kinds["mail.pst"] == kinds["hidden"] == "pst" and kinds["export.olm"] == "olm"
    assert kinds["what.bin"] == "unsupported" and kinds["plain.eml"] == "eml" and kinds["50% box.mbox"] == "mbox"
    path = write("s/index.meta.jsonl", '{"message_id": 5, "excerpt": "a"}\n{broken\n{"message_id": 7, "excerpt": null}\n{}\n')
    assert [r.message_id for r in read_sidecar(spark, str(path)).collect()] == [5, 7]
