"""What a file is, by its name and first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailtables.functions.text import file_name

# File extensions and names of the readable kinds.
EML = r"(?i)\.(eml|txt)$"
MBOX = r"(?i)\.mbox$"
EMLX = r"(?i)\.emlx$"
ICS = r"(?i)\.ics$"
XML = r"(?i)\.xml$"
XML_SKIPPED = "categories.xml"
BODY_PART = r"(?i)(\.com_00(0[0-9]|10)|\.html|\.htm|\.rtf|\.txt)$"
ATTACHMENT_DIR = "com.microsoft.__Attachments"
ARCHIVE = r"(?i)\.zip$"
# The first bytes of zip and PST files.
ZIP_MAGIC = b"PK\x03\x04"
PST_MAGIC = b"!BDN"


def mail_kind(path: Column) -> Column:
    """`eml`, `mbox`, `emlx`, `ics` or `xml` for a readable file, else NULL."""
    return (
        F.when(path.rlike(EML), "eml")
        .when(path.rlike(MBOX), "mbox")
        .when(path.rlike(EMLX), "emlx")
        .when(path.rlike(ICS), "ics")
        .when(path.rlike(XML) & (F.lower(file_name(path)) != XML_SKIPPED), "xml")
    )


def source_kind(path: Column, head: Column | None = None) -> Column:
    """The kind of an input: a mail file kind, `zip`, `pst`, `olm` or `unsupported`; `missing` without a path.

    The extension decides first, so that huge files are told apart without reading them; `head`, the first
    bytes where they are known, decides the rest.
    """
    kind = (
        F.when(path.isNull() | (path == ""), "missing")
        .when(path.rlike(ARCHIVE), "zip")
        .when(path.rlike(r"(?i)\.pst$"), "pst")
        .when(path.rlike(r"(?i)\.olm$"), "olm")
    )
    kind = F.coalesce(kind, mail_kind(path))
    if head is not None:
        magic = F.substring(head, 1, 4)
        kind = F.coalesce(
            kind, F.when(magic == F.lit(ZIP_MAGIC), "zip").when(magic == F.lit(PST_MAGIC), "pst")
        )
    return F.coalesce(kind, F.lit("unsupported"))
