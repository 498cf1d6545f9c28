"""Raw message bytes to parsed columns: the Python stage of the mail sources."""

from __future__ import annotations

import base64
import email.policy
import io
import quopri
import re
from collections.abc import Iterator
from datetime import timezone
from email.message import Message
from email.parser import BytesParser
from email.utils import collapse_rfc2231_value, getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtables.functions.text import html_text
from mailtables.schema import PARSED, RAW, columns

_POLICY = email.policy.default

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_PARSED_ARROW = pa.schema(
    [
        ("path", _TEXT),
        ("kind", _TEXT),
        ("block", pa.int64()),
        ("ordinal", pa.int64()),
        ("modified", pa.timestamp("us", tz="UTC")),
        ("id_header", _TEXT),
        ("from_header", _TEXT),
        ("date_header", _TEXT),
        ("subject_header", _TEXT),
        ("thread_index", _TEXT),
        ("thread_topic", _TEXT),
        ("sender_name", _TEXT),
        ("sender_email", _TEXT),
        ("recipients_to", _TEXTS),
        ("recipients_cc", _TEXTS),
        ("recipients_bcc", _TEXTS),
        ("subject", _TEXT),
        ("body", _TEXT),
        ("sent_at", pa.timestamp("us", tz="UTC")),
        (
            "attachments",
            pa.list_(pa.struct([("filename", _TEXT), ("content_type", _TEXT), ("size_bytes", pa.int64())])),
        ),
        ("error", _TEXT),
    ]
)


def parse_mime(raw: DataFrame) -> DataFrame:
    """Parse raw rows. A message that cannot be read keeps its row, with the reason in `error`."""
    if "error" not in raw.columns:
        raw = raw.withColumn("error", F.lit(None).cast("string"))
    return raw.select(*columns(RAW)).mapInArrow(_parse_batches, PARSED)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser = BytesParser(policy=email.policy.compat32)
    names = _PARSED_ARROW.names
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            content, reason = row.pop("content"), row.pop("error")
            try:
                if content is None:
                    raise ValueError(reason or "no content")
                row.update(_parse(parser, _payload(row["kind"], content)), error=None)
            except Exception as error:
                row["error"] = f"{type(error).__name__}: {error}"
            rows.append(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], type=_PARSED_ARROW.field(n).type) for n in names],
            schema=_PARSED_ARROW,
        )


def _payload(kind: str, content: bytes) -> bytes:
    """The message bytes of a file; an emlx file has a byte count before them and a property list after."""
    if kind == "emlx":
        count, _, rest = content.partition(b"\n")
        if count.strip().isdigit():
            return rest[: int(count)]
    return content


def _parse(parser: BytesParser, content: bytes) -> dict:
    # Reading through a file object gives universal newlines.
    msg = parser.parse(io.BytesIO(content))
    headers: dict[str, list[str]] = {}
    for name, raw in msg.raw_items():
        headers.setdefault(name.lower(), []).append(raw)

    def first(name: str) -> str | None:
        values = headers.get(name.lower())
        return _value(name, values[0]) if values else None

    def addresses(name: str) -> list[str]:
        return [address for raw in headers.get(name.lower(), ()) for address in _addresses(name, raw)]

    sender = first("From")
    subject = first("Subject")
    message_id = first("Message-ID")
    date = headers.get("date", [None])[0]
    body, attachments = _content(msg)
    return {
        "id_header": message_id,
        "from_header": sender,
        # Only an id made from the headers needs the date in its normal form.
        "date_header": first("Date") if date and not (message_id or "").strip() else date and _clean(date),
        "subject_header": subject,
        "thread_index": first("Thread-Index"),
        "thread_topic": first("Thread-Topic"),
        "sender_name": _decoded(sender),
        "sender_email": next(iter(_addresses("From", sender or "")), ""),
        "recipients_to": addresses("To"),
        "recipients_cc": addresses("Cc"),
        "recipients_bcc": addresses("Bcc"),
        "subject": _decoded(subject),
        "body": body,
        "sent_at": _utc(date),
        "attachments": attachments,
    }


def _clean(text: str) -> str:
    """Text that can be written as UTF-8."""
    return text.encode("utf-8", "ignore").decode("utf-8")


# Values that the structured header parser would return unchanged; it is slow, so they do not go through it.
_PLAIN_TEXT = re.compile(r"[!-~](?:[ -~]*[!-~])?")
_PLAIN_ID = re.compile(r"<?[!-;=?-~]+>?")
_PLAIN_ADDRESS = re.compile(r"(?:[A-Za-z0-9 ]+ <)?([\w.+-]+@[\w-]+(?:\.[\w-]+)+)>?", re.ASCII)
_PLAIN_ADDRESSES = re.compile(rf"{_PLAIN_ADDRESS.pattern}(?:,\s+{_PLAIN_ADDRESS.pattern})*", re.ASCII)
_ADDRESS_HEADERS = {"From", "To", "Cc", "Bcc"}


def _value(name: str, raw: str) -> str:
    """A header value, unfolded and decoded; the raw text where the header parser gives up."""
    raw = raw.strip(" ") if name in _ADDRESS_HEADERS else raw
    plain = _PLAIN_ADDRESS if name in _ADDRESS_HEADERS else _PLAIN_ID if name == "Message-ID" else _PLAIN_TEXT
    if name != "Date" and plain.fullmatch(raw) and raw.count("<") == raw.count(">") and "=?" not in raw:
        return raw
    try:
        return _clean(str(_POLICY.header_fetch_parse(name, raw)))
    except Exception:
        return _clean(raw)


_ENCODED_WORD = re.compile(r"=\?([^?\s]+)\?([bq])\?([^?\s]*)\?=(?:\s+(?==\?[^?\s]+\?[bq]\?))?", re.IGNORECASE)


def _encoded_word(match: re.Match) -> str:
    """One encoded word as text; as it stands where its charset or its code is not known."""
    charset, code, data = match[1].partition("*")[0], match[2].lower(), match[3]
    try:
        if code == "b":
            return _clean(base64.b64decode(data + "=" * (-len(data) % 4)).decode(charset, "replace"))
        return _clean(quopri.decodestring(data, header=True).decode(charset, "replace"))
    except (LookupError, ValueError):
        return match[0]


def _decoded(text: str | None) -> str:
    """Encoded words that the header parser left as they were, such as those within quotes."""
    return _ENCODED_WORD.sub(_encoded_word, text or "")


def _addresses(name: str, raw: str) -> list[str]:
    """All addresses of a header value, also of one that strict parsing refuses as a whole."""
    if _PLAIN_ADDRESSES.fullmatch(raw):
        return _PLAIN_ADDRESS.findall(raw)
    value = _value(name, raw)
    found = [address for _, address in getaddresses([value]) if address]
    return found or [address for _, address in getaddresses([value], strict=False) if "@" in address]


def _utc(date: str | None):
    """The Date header as UTC; one without a zone is taken as UTC, one that cannot be read is NULL."""
    try:
        value = parsedate_to_datetime(date)
        return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    except Exception:
        return None


def _text(part: Message) -> str:
    """The text of a part: by its charset, else as UTF-8, else as Latin-1."""
    data = part.get_payload(decode=True) or b""
    charset = part.get_param("charset")
    try:
        if charset is not None:
            return _clean(data.decode(collapse_rfc2231_value(charset), "replace"))
        return data.decode("utf-8")
    except (LookupError, ValueError):
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("latin-1")


def _content(msg: Message) -> tuple[str, list[dict]]:
    """The body (plain text, else the text of the HTML parts) and the attachments' names, types and sizes.

    Whatever part of a multipart message is no body text is an attachment, also one shown inline.
    """
    plain, marked_up, attachments = [], [], []
    single = not msg.is_multipart()
    for part in msg.walk():
        kind = part.get_content_type()
        attached = part.get_content_disposition() == "attachment" or part.get_filename() is not None and not single
        if single and part.get_content_maintype() == "text" or kind in _BODY_TYPES and not attached:
            (marked_up if kind == "text/html" else plain).append(_text(part))
        elif attached or not part.is_multipart() and not single:
            attachments.append(_attachment(part))
    if plain:
        return "\n\n".join(plain), attachments
    return "\n\n".join(html_text(text) for text in marked_up), attachments


_BODY_TYPES = {"text/plain", "text/html"}


def _attachment(part: Message) -> dict:
    if part.is_multipart():
        size = sum(len(bytes(inner)) for inner in part.get_payload())
    else:
        size = len(part.get_payload(decode=True) or b"")
    return {
        "filename": _clean(part.get_filename() or "attachment"),
        "content_type": _clean(part.get_content_type()),
        "size_bytes": size,
    }
