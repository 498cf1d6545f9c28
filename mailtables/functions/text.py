"""Text columns: trimming, excerpts, decoding, HTML to text, LIKE matching, display."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailtables.functions.patterns import WHITESPACE

# Fixed value of the display rules.
SUBJECT_CHARS = 80


def strip(text: Column) -> Column:
    """Python's `str.strip()`; SQL `trim` alone removes only blanks."""
    return F.trim(text, F.lit(WHITESPACE))


def excerpt(subject: Column, body: Column, chars: int | None = None) -> Column:
    """Trimmed subject, a blank line and the trimmed body; whole, or cut to `chars`."""
    text = F.concat(strip(F.coalesce(subject, F.lit(""))), F.lit("\n\n"), strip(F.coalesce(body, F.lit(""))))
    return text if chars is None else F.substring(text, 1, chars)


def decode_bytes(content: Column) -> Column:
    """Bytes to text: UTF-8 where valid, else Latin-1."""
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))


# Comments, blocks whose text is not shown, and every other tag, in that order. What is not closed runs to the end, so
# no start is looked at twice. `{end}` is the end of the text, which Java and Python write differently.
_MARKUP = (
    r"(?is)<!--.*?(?:-->|{end})|<(script|style|template)\b[^>]*+(?:>|{end}).*?(?:</\1\s*+>|{end})"
    r"|<[a-z/!?][^>]*+(?:>|{end})"
)
MARKUP = _MARKUP.replace("{end}", r"\z")
_PYTHON_MARKUP = re.compile(_MARKUP.replace("{end}", r"\Z"))
_CUT = "\x01"


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def html_to_text(text: Column) -> Column:
    """Text nodes joined by a newline, entities decoded.

    Each piece of markup becomes a cut mark; marks at the ends go, every other run of marks is one newline.
    """
    cut = F.trim(F.regexp_replace(text, MARKUP, _CUT), F.lit(_CUT))
    plain = F.regexp_replace(cut, _CUT + "+", "\n")
    return F.coalesce(unescape_entities(F.when(F.contains(plain, F.lit("&")), plain)), plain)


def html_text(text: str) -> str:
    """`html_to_text` for one string, for code that is already inside a Python stage."""
    cut = _PYTHON_MARKUP.sub(_CUT, text).strip(_CUT)
    return html.unescape(re.sub(_CUT + "+", "\n", cut))


def looks_like_html(text: Column) -> Column:
    lowered = F.lower(text)
    return F.contains(lowered, F.lit("<html")) | F.contains(lowered, F.lit("</p>"))


def like_anywhere(column: Column, query: str) -> Column:
    """`column LIKE '%query%'` with SQLite's rules: ASCII letters fold, `%` and `_` in the query are wildcards.

    Java's `(?i)` folds ASCII only, which is exact. The texts between `%` are looked for one after the other and
    never again (atomic groups): the first place of each is as good as any, and a long text stays linear. For an
    ASCII query a byte search over the lower-cased column, which never misses a match, runs first so that the
    regex sees only its hits.
    """
    segments = [segment for segment in query.split("%") if segment]
    exact = [".".join(re.escape(part) for part in segment.split("_")) for segment in segments]
    if len(exact) > 1:
        exact = [r"\A", *(f"(?>.*?{segment})" for segment in exact)]
    matched = F.rlike(column, F.lit("(?is)" + "".join(exact)))
    if not query.isascii():
        return matched
    lowered = F.lower(column)
    for part in dict.fromkeys(part.lower() for segment in segments for part in segment.split("_") if part):
        matched = F.contains(lowered, F.lit(part)) & matched
    return matched


def display_subject(subject: Column) -> Column:
    return F.substring(F.coalesce(subject, F.lit("")), 1, SUBJECT_CHARS)


def display_score(score: Column) -> Column:
    return F.format_string("%.3f", score)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
