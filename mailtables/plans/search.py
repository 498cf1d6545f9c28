"""Questions to the tables: keyword search, dossier, timeline, semantic search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.operators.dedupe import broadcast_if_small

from mailtables.functions.text import display_score, display_subject, like_anywhere
from mailtables.operators.vectors import TOP_K, top_k

# How many rows the reports show.
SEARCH_ROWS = 50
DOSSIER_ROWS = 500

SEARCH_COLUMNS = ["message_id", "sent_at", "sender_email", "subject", "account_tag"]
DOSSIER_COLUMNS = ["message_id", "sent_at", "sender_email", "subject"]


def newest_first(time: str = "sent_at", key: str = "message_id") -> list[Column]:
    return [F.desc_nulls_last(time), F.asc(key)]


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a sorted result; all of them, by a distributed sort, without a limit."""
    return rows if limit is None else rows.limit(limit)


def matches(query: str, fields: Sequence[str] = ("subject", "body")) -> Column:
    """The query occurs in one of the fields; a NULL field does not match."""
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(like_anywhere(F.col(field), query), F.lit(False))
    return found


def matches_terms(
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    fields: Sequence[str] = ("subject", "body"),
) -> Column:
    """Every term of `all_of`, one of `any_of` (if given) and no term of `none_of` occurs."""
    wanted = F.lit(True)
    for term in all_of:
        wanted = wanted & matches(term, fields)
    if any_of:
        one = F.lit(False)
        for term in any_of:
            one = one | matches(term, fields)
        wanted = wanted & one
    for term in none_of:
        wanted = wanted & ~matches(term, fields)
    return wanted


def keyword_search(messages: DataFrame, wanted: str | Column, limit: int | None = SEARCH_ROWS) -> DataFrame:
    """The newest messages that match a query text or a condition from `matches_terms`; None for all of them."""
    condition = matches(wanted) if isinstance(wanted, str) else wanted
    return _first(messages.where(condition).select(*SEARCH_COLUMNS).orderBy(*newest_first()), limit)


def search_report(hits: DataFrame) -> DataFrame:
    """Search hits as shown: no NULLs, long subjects cut."""
    blank = F.lit("")
    return hits.select(
        F.coalesce(F.col("message_id").cast("string"), blank).alias("id"),
        F.coalesce(F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), blank).alias("sent_at"),
        F.coalesce("sender_email", blank).alias("sender_email"),
        F.coalesce("account_tag", blank).alias("account_tag"),
        display_subject(F.col("subject")).alias("subject"),
    )


def dossier(messages: DataFrame, account: str, limit: int | None = DOSSIER_ROWS, report: bool = False) -> DataFrame:
    """The newest messages of one account; `report` keeps only what a dossier shows, so bodies are not read."""
    own = messages.where(F.col("account_tag") == account)
    if report:
        own = own.select(*DOSSIER_COLUMNS)
    return _first(own.orderBy(*newest_first()), limit)


def timeline(messages: DataFrame, account: str) -> DataFrame:
    """All messages of one account, oldest first, undated ones before. The sort is range-partitioned."""
    return (
        messages.where(F.col("account_tag") == account)
        .select("message_id", "subject", "sender_email", "sent_at")
        .orderBy(F.asc_nulls_first("sent_at"), F.asc("message_id"))
    )


def semantic_search(messages: DataFrame, embeddings: DataFrame, query: list[float], k: int | None = TOP_K) -> DataFrame:
    """The messages nearest to a query vector, best first; `k` hits are broadcast to the messages, all of them are not."""
    hits = top_k(embeddings, "message_id", query, k)
    found = messages.select("message_id", "sent_at", "sender_email", "subject", "account_tag")
    ranked = (
        found.join(hits if k is None else broadcast_if_small(hits), "message_id")
        .select(
            "message_id",
            "score",
            display_score(F.col("score")).alias("shown_score"),
            "sent_at",
            "sender_email",
            "subject",
            "account_tag",
        )
        .orderBy(F.desc("score"), F.asc("message_id"))
    )
    return _first(ranked, k)
