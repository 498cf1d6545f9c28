"""Hand-written messages, calendars and rules."""

PLAIN = b"""From: ann@example.com
To: bo@acme.example, Cy Dee <cy@globex.example>
Cc: "Last, First" <lf@example.org>
Subject: =?utf-8?q?Caf=C3=A9_plans?=
Date: Tue, 2 Jan 2024 12:00:00 +0200
Message-ID: <plain@example.com>
Thread-Topic: plans
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: 8bit

Meet on 2024-01-05, bring $1,250.00.
Write to bo@acme.example.
"""

NO_ZONE = b"From: a@x.example\nDate: Mon, 1 Jan 2024 10:00:00 -0000\nSubject: naive\nMessage-ID: <naive@x>\n\nhi\n"
BAD_DATE = b"From: a@x.example\nDate: sometime soon\nSubject: bad date\nMessage-ID:  <bad@x> \n\nhi\n"
NO_ID = b"From: a@x.example\nSubject: no id\n\nhi\n"

MULTIPART = b"""From: Ann <ann@example.com>
To: bo@acme.example
Subject: parts
Date: Wed, 3 Jan 2024 00:00:00 GMT
Message-ID: <multi@example.com>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="OUT"

--OUT
Content-Type: multipart/alternative; boundary="IN"

--IN
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

first caf=E9
--IN
Content-Type: text/html

<html><p>first</p></html>
--IN--
--OUT
Content-Type: text/plain

second
--OUT
Content-Type: application/pdf; name="report.pdf"
Content-Disposition: attachment; filename="report.pdf"
Content-Transfer-Encoding: base64

SGVsbG8=
--OUT
Content-Type: text/plain
Content-Disposition: attachment; filename="notes.txt"

not the body
--OUT--
"""

HTML_ONLY = b"""From: ann@example.com
Subject: markup
Message-ID: <html@example.com>
Content-Type: text/html; charset=utf-8

<html><head><style>p{}</style></head><body><p>One &amp; two</p><!-- x --><p>three</p></body></html>
"""

TRUNCATED = MULTIPART[: MULTIPART.index(b"second")].replace(b"<multi@", b"<cut@")

LATIN1 = (
    b"From: l@x.example\nSubject: latin\nMessage-ID: <latin@x>\n"
    b"Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\ncaf\xe9\n"
)

MBOX = (
    b"From a@x.example Mon Jan  1 00:00:00 2024\n" + NO_ZONE + b"\n"
    b"From b@x.example Mon Jan  1 00:00:00 2024\n" + LATIN1 + b"\n"
    b"From c@x.example Mon Jan  1 00:00:00 2024\n"
    b"From: q@x.example\nSubject: quoted\nMessage-ID: <quoted@x>\n\n>From here on\n>>From there\nFromage\n"
)

EMLX_MAIL = b"From: e@x.example\nSubject: emlx\nMessage-ID: <emlx@x>\n\npayload\n"
EMLX = b"%d      \n" % len(EMLX_MAIL) + EMLX_MAIL + b'<?xml version="1.0"?><plist><dict/></plist>\n'

CALENDAR = (
    "BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"
    "BEGIN:VEVENT\r\nSUMMARY:A long \r\n title\r\nDTSTART;TZID=Europe/Paris:20240105T093000\r\n"
    "DTEND:20240105T103000Z\r\nLOCATION:Room 1\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nsummary;language=en:First\r\nSUMMARY:Last: wins\r\nDTSTART;VALUE=DATE:20240106\r\n"
    "DTEND:tomorrow\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nSUMMARY:never ends\r\n"
    "BEGIN:VEVENT\r\nSUMMARY:after\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
)

RULES = """
semantic:
  enabled: true
tagging:
  domains_weight: 2
  keyword_weight: 1
accounts:
  - name: Acme
    aliases: [acme, "acme inc"]
    domains: [acme.example]
    partners: [Globex]
    keywords: [RFP, contract]
  - name: Globex
    aliases: [globex]
    domains: [globex.example]
    partners: [Initech, Globex]
    keywords: [invoice]
  - name: Silent
    aliases: [nobody says this]
    partners: [Hooli]
overrides:
  addresses:
    boss@acme.example: Board
  subject_patterns:
    - pattern: "^Ticket [0-9]+ (?i:urgent)"
      account: Helpdesk
    - pattern: "Ticket"
      account: Second
"""
