"""Date texts to UTC timestamps. A text that cannot be read gives NULL; one without a zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The zone names of mail dates. Any other name counts as UTC, as in the mail parser.
ZONES = {
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800",
    "PDT": "-0700",
}


def mail_date(text: Column) -> Column:
    """A mail Date header such as `Mon, 1 Jan 2024 10:00:00 +0000 (UTC)`.

    Week-day letters make Spark's parser throw even in its `try_` form, so they are removed first.
    """
    bare = F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*|\s*\(.*\)\s*$", "")
    zoned = bare
    for name, offset in ZONES.items():
        zoned = F.regexp_replace(zoned, rf"\s+{name}$", f" {offset}")
    zoned = F.regexp_replace(zoned, r"\s+(?!(?i:[ap]m)$)[A-Za-z]{1,5}$", " +0000")
    zoned = F.when(zoned.rlike(r"[+-]\d{4}$"), zoned).otherwise(F.concat(zoned, F.lit(" +0000")))
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
    )


def calendar_date(text: Column) -> Column:
    """A calendar date: `20240101T100000Z`, `20240101T100000` or `20240101`."""
    value = F.trim(text)
    zoned = (
        F.when(value.rlike(r"^\d{8}$"), F.concat(value, F.lit("T000000Z")))
        .when(value.rlike(r"^\d{8}T\d{6}$"), F.concat(value, F.lit("Z")))
        .otherwise(value)
    )
    return F.try_to_timestamp(zoned, F.lit("yyyyMMdd'T'HHmmssX"))


def iso_date(text: Column) -> Column:
    """An ISO 8601 date or date-time."""
    parts = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?\s*(Z|[+-]\d{2}:?\d{2})?\s*$"
    day, time, zone = (F.regexp_extract(text, parts, i) for i in (1, 2, 3))
    time = F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    zone = F.when(zone == "", F.lit("Z")).otherwise(F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    return F.when(day != "", F.try_to_timestamp(F.concat(day, F.lit("T"), time, zone)))


def any_date(text: Column) -> Column:
    """The date of an XML message, which may be in either form."""
    return F.coalesce(iso_date(text), mail_date(text))


def iso_text(time: Column) -> Column:
    """A timestamp as `YYYY-MM-DDTHH:MM:SSZ`."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
