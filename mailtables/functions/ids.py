"""Message identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailtables.functions.text import strip


def external_id(id_header: Column, from_header: Column, date_header: Column, subject_header: Column) -> Column:
    """The trimmed Message-ID, else SHA-1 of From + Date + Subject."""
    blank = F.lit("")
    parts = [F.coalesce(c, blank) for c in (from_header, date_header, subject_header)]
    return F.coalesce(F.nullif(strip(id_header), blank), F.sha1(F.concat(*parts).cast("binary")))


def message_id(external: Column) -> Column:
    """The numeric id, a function of the external id so that every task and every run agrees on it."""
    return F.xxhash64(external)


def thread_id(index: Column, topic: Column) -> Column:
    return F.coalesce(F.nullif(index, F.lit("")), F.nullif(topic, F.lit("")))
