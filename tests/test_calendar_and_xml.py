import datetime as dt
import hashlib

import samples as S
from mailtables.operators import parts
from mailtables.plans.messages import xml_records
from mailtables.sources import calendars, files, xml_messages


def test_calendar(spark, write, tmp_path):
    write("cal/a.ics", S.CALENDAR)
    write("cal/b.ICS", "BEGIN:VEVENT\nSUMMARY:alone\nEND:VEVENT")
    write("cal/c.ics", b"BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:bad \xff byte\nEND:VEVENT\n")
    rows = {row.title: row for row in calendars.read_ics(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A long title", "Last: wins", "after", "alone", "bad  byte"}
    first = rows["A long title"]
    assert first.starts_at == dt.datetime(2024, 1, 5, 9, 30) and first.ends_at == dt.datetime(2024, 1, 5, 10, 30)
    assert first.location == "Room 1" and first.kind == "calendar" and first.message_id is None
    second = rows["Last: wins"]
    assert second.starts_at == dt.datetime(2024, 1, 6) and second.ends_at is None and second.location is None

    whole = files.as_raw(files.read_files(spark, str(tmp_path), files.GLOBS["ics"]), "ics")
    assert {row.title for row in calendars.events_in_content(whole).collect()} == set(rows)


XML = """<?xml version="1.0"?>
<root xmlns:m="urn:m">
  <m:Subject> From the archive </m:Subject>
  <OPFMessageCopySubject>later choice</OPFMessageCopySubject>
  <m:to>x@one.example and y@two.example<b>z@no.example</b></m:to><To>x@one.example</To>
  <sent>Mon, 1 Jan 2024 10:00:00 +0100</sent>
  {sender}
</root>"""


def test_xml_messages(spark, write, tmp_path):
    write("x/named.xml", XML.format(sender="<from>Ann &lt;ann@x.example&gt;</from>"))
    write("x/attr.xml", XML.format(sender='<from>Ann</from><m:emailAddress n="Ann" a="attr@x.example"/>'))
    write("x/any.xml", XML.format(sender="<from>Ann</from>"))
    write("x/blank.xml", "<root><from>a@b.example</from></root>")
    write("x/bad.xml", "<root><from>")
    write("x/Categories.xml", "<root><subject>no</subject></root>")
    rows = {row.path.split("/")[-1]: row for row in xml_messages.read_xml_messages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"named.xml", "attr.xml", "any.xml"}
    named = rows["named.xml"]
    assert named.subject == "From the archive" and named.sender_email == "ann@x.example" and named.body is None
    assert named.recipients_to == ["x@one.example", "y@two.example"] and named.recipients_cc == []
    assert named.sent_at == dt.datetime(2024, 1, 1, 9)
    assert named.external_id == hashlib.sha1((named.path + named.subject).encode()).hexdigest()
    assert rows["attr.xml"].sender_email == "attr@x.example"
    assert rows["any.xml"].sender_email == "x@one.example"


def test_body_and_attachments_from_siblings(spark, write, tmp_path):
    write("m1/message.xml", "<r><subject>s</subject></r>")
    write("m1/a.com_0001", "  first  ")
    write("m1/b.html", "<html><p>caf&eacute; &amp; <b>tea</b></p></html>")
    write("m1/c.txt", b"caf\xe9")
    write("m1/d.rtf", " \n ")
    write("m1/ignored.dat", "no")
    for number in range(12):
        write(f"m1/com.microsoft.__Attachments/{number:02}.{'xml' if number % 4 == 0 else 'pdf'}", "x" * (number + 1))
    write("m2/message.xml", "<r><subject>s</subject><body>own</body></r>")
    write("m2/a.txt", "not used")
    root = str(tmp_path)
    listed = files.read_files(spark, root)
    records = xml_records(
        xml_messages.read_xml_messages(spark, root),
        parts.bodies_from_parts(parts.part_texts(listed)),
        parts.attachment_lists(files.list_files(spark, root), 10),
    )
    rows = {row.path.split("/")[-2]: row for row in records.collect()}
    assert rows["m1"].body == "first\n\ncafé & \ntea\n\ncafé"
    assert [(a.filename, a.size_bytes) for a in rows["m1"].attachments] == [
        (f"{n:02}.pdf", n + 1) for n in range(10) if n % 4
    ]
    assert rows["m2"].body == "own" and rows["m2"].attachments == []
