"""The registered queries: each runs one or more operators over whole given tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from contract.runs import RUNS
from contract.views import (
    DOCUMENT_RULES, PAGE_RULES, bare, conversation_mail, customer_xml, document_messages, joined, pack, page_messages, table, utc,
)
from mailtables.functions import charsets, text as X
from mailtables.functions.ids import external_id
from mailtables.functions.times import mail_date
from mailtables.operators import (
    dedupe, entities, id_buckets, ordinals, parts, tagging, trigram_index, vector_search, vectors,
)
from mailtables.plans import ingest, messages as M, query_text, search
from mailtables.session import scratch_dir
from mailtables.sinks import csv_export, tables
from mailtables.sources import calendars, files, kinds, mime, xml_messages, zips

Query = Callable[[SparkSession, str], DataFrame]


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """Add `pos` to a result of at most a few hundred rows, so that its order can be compared."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


# --- reading mail ---------------------------------------------------------------------------------------------


def mime_roundtrip(spark, sf_dir):
    parsed = mime.parse_mime(conversation_mail(table(spark, sf_dir, "conversations", heavy=True)))
    return parsed.select(
        F.col("block").alias("conv_id"),
        F.col("ordinal").alias("turn"),
        "sender_email",
        joined("recipients_to").alias("recipients_to"),
        joined("recipients_cc").alias("recipients_cc"),
        "subject",
        "body",
        bare(F.col("sent_at")).alias("sent_at"),
        "error",
    )


def message_record(spark, sf_dir):
    parsed = mime.parse_mime(conversation_mail(table(spark, sf_dir, "conversations", heavy=True)))
    rows = csv_export.flat_columns(M.message_rows(M.complete(M.mail_records(parsed), tagging.Rules())))
    return rows.drop("message_id")


def external_ids(spark, sf_dir):
    blank = F.lit(None).cast("string")
    id_header = F.when(
        F.col("role") == "user", F.concat(F.lit("\t <"), F.col("conv_id"), F.lit("."), F.col("turn"), F.lit("@x> "))
    ).when(F.col("role") == "system", F.lit("   "))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", external_id(id_header, F.col("role"), blank, F.col("text")).alias("external_id")
    )


def mail_dates(spark, sf_dir):
    shown = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0230 (X)"))
    header = F.when(F.col("o_orderstatus") == "P", F.lit("not a date")).otherwise(shown)
    return table(spark, sf_dir, "orders").select("o_orderkey", bare(mail_date(header)).alias("sent_at"))


def mbox_ordinal(spark, sf_dir):
    """Mailboxes of a hundred conversations and a thousand turns each, written as mbox text and read back."""
    turns = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 100).alias("box"),
        F.floor(F.col("turn") / 1000).alias("volume"),
        "conv_id",
        "turn",
        F.concat(
            F.lit("From archive@example.com Mon Jan  1 00:00:00 2024\nSubject: "),
            F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit("\n\n"),
            F.regexp_replace("text", "(?m)^(>*From )", ">$1"), F.lit("\n"),
        ).alias("message"),
    )
    folder = scratch_dir(spark, "mbox")
    order = ["box", "volume", "conv_id", "turn"]
    (
        turns.repartition("box", "volume").sortWithinPartitions(*order)
        .select("box", "volume", "message").write.partitionBy("box", "volume").text(folder)
    )
    raw = files.read_mbox(spark, folder, "*.txt")
    ids = F.split("subject", "/")
    return ordinals.number_messages(mime.parse_mime(raw), raw).select(
        ids[0].cast("bigint").alias("conv_id"),
        ids[1].cast("bigint").alias("turn"),
        F.col("position").cast("bigint").alias("position"),
        F.length(F.rtrim(F.col("body"), F.lit("\n"))).cast("bigint").alias("chars"),
    )


def ics_events(spark, sf_dir):
    stamp = "yyyyMMdd'T'HHmmss"
    event = F.concat(
        F.lit("BEGIN:VEVENT\nUID:"), F.col("event_id"),
        F.lit("\nDTSTART;TZID=Etc/UTC:"), F.date_format("ts", stamp),
        F.lit("\ndtend:"), F.date_format(F.col("ts") + F.expr("INTERVAL 30 MINUTES"), stamp), F.lit("Z"),
        F.lit("\nSUMMARY:"), F.col("event_type"), F.lit(" of \n  user "), F.col("user_id"),
        F.lit("\nLOCATION:"), F.col("props"), F.lit("\nEND:VEVENT"),
    )
    folder = scratch_dir(spark, "ics")
    table(spark, sf_dir, "events", heavy=True).select(event.alias("value")).write.text(folder)
    return calendars.read_ics(spark, folder, "*.txt").select(
        "kind", "title", bare(F.col("starts_at")).alias("starts_at"), bare(F.col("ends_at")).alias("ends_at"),
        "location",
    )


def zip_entries(spark, sf_dir):
    """Documents packed into zip archives by the tasks that hold them, then listed and read in place."""
    folder = scratch_dir(spark, "zips")
    texts = table(spark, sf_dir, "documents", heavy=True)
    pack(texts.select(F.concat(F.lit("texts/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("text").alias("content")), folder)
    raw = zips.read_zip_entries(zips.list_zip_entries(spark, folder))
    return raw.select(
        F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint").alias("doc_id"),
        F.length("content").cast("bigint").alias("size_bytes"),
        F.sha1("content").alias("digest"),
    )


def xml_message_rows(spark, sf_dir):
    return xml_messages.xml_messages(xml_messages.flatten_xml(customer_xml(spark, sf_dir))).select(
        "path", "external_id", "subject", "body", "sender_email", joined("recipients_to").alias("recipients_to"),
        bare(F.col("sent_at")).alias("sent_at"),
    )


def xml_bodies(spark, sf_dir):
    """A message without a body in every customer's folder, rebuilt from the customer's orders as part files."""
    number = F.col("c_custkey").cast("string")
    content = F.concat(F.lit("<email><subject>"), F.col("c_name"), F.lit("</subject></email>"))
    source = table(spark, sf_dir, "customer", heavy=True).select(
        F.concat(F.lit("xml/"), number, F.lit("/message.xml")).alias("path"),
        F.lit(0).cast("timestamp").alias("modified"),
        content.cast("binary").alias("content"),
    )
    orders = table(spark, sf_dir, "orders", heavy=True)
    part = F.concat(
        F.lit("xml/"), F.col("o_custkey"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
        F.lit(".com_0001"),
    )
    page = F.concat(
        F.lit("<html><p>Order "), F.col("o_orderkey"), F.lit("</p><p>"), F.col("o_orderpriority"), F.lit("</p></html>")
    )
    part_files = orders.select(part.alias("path"), page.cast("binary").alias("content"))
    attached = orders.select(
        F.concat(
            F.lit("xml/"), F.col("o_custkey"), F.lit(f"/{kinds.ATTACHMENT_DIR}/"), F.col("o_orderkey"),
            F.when(F.col("o_orderstatus") == "F", ".xml").otherwise(".pdf"),
        ).alias("path"),
        F.col("o_orderkey").alias("size_bytes"),
    )
    xml = xml_messages.xml_messages(xml_messages.flatten_xml(source))
    bodies = parts.bodies_from_parts(parts.part_texts(part_files), 200)
    records = M.xml_records(xml, bodies, parts.attachment_lists(attached, 10))
    return records.select(
        "path", "subject", "body",
        F.array_join(F.transform("attachments", lambda a: F.concat(a["filename"], F.lit(":"), a["size_bytes"])), ";")
        .alias("attachments"),
    )


def source_kind(spark, sf_dir):
    endings = [".eml", ".TXT", ".mbox", ".emlx", ".ics", ".xml", "/Categories.XML", ".zip", ".pst", ".olm", ".dat", ""]
    name = F.regexp_replace("url", r"[?#].*$|\.html$", "")
    path = F.concat(name, F.get(F.array(*[F.lit(e) for e in endings]), (F.col("page_id") % len(endings)).cast("int")))
    path = F.when(F.col("page_id") % 25 == 24, F.lit("")).otherwise(path)
    head = F.when(F.col("page_id") % 2 == 0, F.lit(kinds.ZIP_MAGIC)).otherwise(F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", kinds.source_kind(path, head).alias("source_kind"))


# --- tagging and entities -------------------------------------------------------------------------------------


def tag_accounts(spark, sf_dir):
    tagged = tagging.tag_accounts(document_messages(table(spark, sf_dir, "documents", heavy=True)), DOCUMENT_RULES)
    return tagged.select(
        F.col("message_id").alias("doc_id"), "account_tag", joined("partner_tags").alias("partner_tags")
    )


def tag_rows(spark, sf_dir):
    tagged = tagging.tag_accounts(document_messages(table(spark, sf_dir, "documents", heavy=True)), DOCUMENT_RULES)
    return tagging.tag_rows(tagged).withColumnRenamed("message_id", "doc_id")


# Syllables of the invented prose, of which the customer rules make their words.
SYLLABLES = ("th", "at", "in", "on", "er", "an", "re", "en", "st", "he", "ble", "tion")


def _syllable_word(key):
    """A word of three syllables that a number spells in base 12, lowest digit first."""
    s = F.array(*[F.lit(x) for x in SYLLABLES])
    n = len(SYLLABLES)
    return F.concat(*[F.get(s, (F.floor(key / n ** i) % n).cast("int")) for i in range(3)])


def customer_rules(spark, sf_dir) -> tagging.Rules:
    """One account per customer, in key order: an alias and a keyword made of syllables, a source's domain and a
    partner, so that the rules grow with the table."""
    key = F.col("c_custkey")
    accounts = table(spark, sf_dir, "customer").select(
        key.alias("place"), F.col("c_name").alias("name"), F.array(_syllable_word(key)).alias("aliases"),
        F.array(F.concat(F.lit("src"), key % 20, F.lit(".example.net"))).alias("domains"),
        F.array(F.initcap(_syllable_word(key * 3 + 1))).alias("partners"),
        F.array(_syllable_word(key * 5 + 3)).alias("keywords"),
    )
    return tagging.table_rules(accounts)


def tag_many_accounts(spark, sf_dir):
    messages = document_messages(table(spark, sf_dir, "documents", heavy=True))
    tagged = tagging.tag_accounts(messages, customer_rules(spark, sf_dir))
    return tagged.select(
        F.col("message_id").alias("doc_id"), "account_tag", joined("partner_tags").alias("partner_tags")
    )


def tag_overrides(spark, sf_dir):
    tagged = tagging.tag_accounts(page_messages(table(spark, sf_dir, "pages")), PAGE_RULES)
    return tagged.select(
        F.col("message_id").alias("page_id"), "account_tag", joined("partner_tags").alias("partner_tags")
    )


def _entity_texts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", heavy=True).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("message_id"), F.col("text").alias("body")
    )
    sentence = F.concat(
        F.lit("Order "), F.col("o_orderkey"), F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" (due "), F.date_format("o_orderdate", "M/d/yy"), F.lit("): $"),
        F.format_number("o_totalprice", 2), F.lit(", écrire à c"), F.col("o_custkey"),
        F.lit("@example.com 😀 or sales@example.com."),
    )
    orders = table(spark, sf_dir, "orders", heavy=True).select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("message_id"), sentence.alias("body")
    )
    return documents.unionByName(orders)


def entities_regex(spark, sf_dir):
    return entities.entity_rows(entities.add_entities(_entity_texts(spark, sf_dir))).select(
        "message_id", "label", "text", F.col("start_char").cast("bigint"), F.col("end_char").cast("bigint")
    )


def emails_distinct(spark, sf_dir):
    found = xml_messages.distinct_emails(F.array("text"))
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", joined(F.array_sort(found)).alias("emails"))


# --- search, reports ------------------------------------------------------------------------------------------


def _hits(hits):
    numbered = _numbered(hits, *search.newest_first())
    return numbered.select(
        "pos", "message_id", bare(F.col("sent_at")).alias("sent_at"), "sender_email", "account_tag",
        X.display_subject(F.col("subject")).alias("subject"),
    )


def keyword_search(spark, sf_dir):
    return _hits(search.keyword_search(document_messages(table(spark, sf_dir, "documents")), "HeHely"))


def keyword_wildcard(spark, sf_dir):
    return _hits(search.keyword_search(document_messages(table(spark, sf_dir, "documents")), "the%on_nst", 100))


def keyword_boolean(spark, sf_dir):
    wanted = search.matches_terms(all_of=["the"], any_of=["thatin", "hehely"], none_of=["ononst"])
    return _hits(search.keyword_search(document_messages(table(spark, sf_dir, "documents")), wanted))


#: The documented form of a search text, over the words of the documents.
SEARCH_TEXT = "thatin AND (hehely OR ononst) NOT \"ering ou\""


def keyword_query_text(spark, sf_dir):
    wanted = query_text.condition(SEARCH_TEXT)
    return _hits(search.keyword_search(document_messages(table(spark, sf_dir, "documents")), wanted))


def _bucketed_documents(spark, sf_dir):
    """The documents stored in id buckets, and the micro-batch of ids to look up: those labelled toxic."""
    folder = scratch_dir(spark, "bucketed-documents")
    id_buckets.write_bucketed(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), folder, "doc_id")
    return folder, table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")


def id_lookup(spark, sf_dir):
    """Stored documents of a micro-batch of ids, read from their id buckets only."""
    folder, batch = _bucketed_documents(spark, sf_dir)
    return id_buckets.matching(spark, folder, "doc_id", batch)


def id_lookup_reads(spark, sf_dir):
    """Buckets the micro-batch reads, of all buckets the store holds, and the rows it finds."""
    folder, batch = _bucketed_documents(spark, sf_dir)
    read = len(id_buckets.batch_buckets(batch, "doc_id"))
    stored = spark.read.parquet(folder)
    found = id_buckets.matching(spark, folder, "doc_id", batch)
    return found.agg(F.count("*").alias("rows")).select(
        F.lit(read).alias("buckets_read"), F.lit(stored.select("id_bucket").distinct().count()).alias("buckets_stored"),
        "rows",
    )


def keyword_query_all(spark, sf_dir):
    """Every message that the search text finds, newest first: the report without its 50-row limit."""
    wanted = query_text.condition(SEARCH_TEXT)
    return _hits(search.keyword_search(document_messages(table(spark, sf_dir, "documents")), wanted, None))


def _indexed_messages(spark, sf_dir):
    """The document messages and a trigram index of them, written as one stored batch."""
    messages = document_messages(table(spark, sf_dir, "documents"))
    folder = scratch_dir(spark, "trigram-index")
    trigram_index.write_batch(messages, folder)
    return messages, spark.read.parquet(folder)


#: The searches of the indexed queries: (all_of, any_of, none_of), as the plain queries above run them.
INDEXED_SEARCHES = {
    "HeHely": (["HeHely"], [], []),
    "the%on_nst": (["the%on_nst"], [], []),
    "the AND (thatin OR hehely) AND NOT ononst": (["the"], ["thatin", "hehely"], ["ononst"]),
}


def _indexed_search(spark, sf_dir, name, limit=search.SEARCH_ROWS):
    messages, index = _indexed_messages(spark, sf_dir)
    all_of, any_of, none_of = INDEXED_SEARCHES[name]
    narrowed = trigram_index.narrowed(messages, trigram_index.candidates(index, all_of, any_of))
    return _hits(search.keyword_search(narrowed, search.matches_terms(all_of, any_of, none_of), limit))


def keyword_search_indexed(spark, sf_dir):
    return _indexed_search(spark, sf_dir, "HeHely")


def keyword_wildcard_indexed(spark, sf_dir):
    return _indexed_search(spark, sf_dir, "the%on_nst", 100)


def keyword_boolean_indexed(spark, sf_dir):
    return _indexed_search(spark, sf_dir, "the AND (thatin OR hehely) AND NOT ononst")


def keyword_index_reads(spark, sf_dir):
    """Per search: the messages the index leaves to verify (bodies read), all messages, and the matches."""
    messages, index = _indexed_messages(spark, sf_dir)
    rows = []
    for name, (all_of, any_of, none_of) in INDEXED_SEARCHES.items():
        narrowed = trigram_index.narrowed(messages, trigram_index.candidates(index, all_of, any_of))
        counted = narrowed.agg(
            F.count("*").alias("bodies_read"),
            F.count_if(search.matches_terms(all_of, any_of, none_of)).alias("hits"),
        )
        rows.append(counted.select(F.lit(name).alias("search"), "bodies_read", "hits"))
    whole = messages.agg(F.count("*").alias("bodies_read")).select(
        F.lit("(all messages)").alias("search"), "bodies_read", F.lit(None).cast("bigint").alias("hits")
    )
    result = whole
    for other in rows:
        result = result.unionByName(other)
    return result


def _order_messages(spark, sf_dir):
    """Orders as messages; the account is the customer's segment."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("message_id"),
        utc("o_orderdate").alias("sent_at"),
        F.col("c_name").alias("sender_email"),
        F.col("o_orderpriority").alias("subject"),
        F.col("c_mktsegment").alias("account_tag"),
    )


def dossier(spark, sf_dir):
    newest = search.dossier(_order_messages(spark, sf_dir), "BUILDING", report=True)
    return _numbered(newest, *search.newest_first()).withColumn("sent_at", bare(F.col("sent_at")))


def timeline(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("message_id"),
        F.col("props").alias("subject"),
        F.concat(F.lit("user-"), F.col("user_id"), F.lit("@example.com")).alias("sender_email"),
        utc("ts").alias("sent_at"),
        F.col("event_type").alias("account_tag"),
    )
    return search.timeline(events, "error").withColumn("sent_at", bare(F.col("sent_at")))


def excerpts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    subject = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\t "), F.col("source"), F.lit(" \n")))
    body = F.concat(F.lit("\n\n "), F.col("text"), F.lit(" \n"))
    return documents.select("doc_id", X.excerpt(subject, body, 2000).alias("excerpt"))


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages", heavy=True).select("page_id", X.html_to_text(F.col("html")).alias("text"))


# Letters a to z written in three other scripts, for texts that only those charsets encode.
LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {
    "cp1251": "абцдефгхийклмнопярстувшжыз",
    "shift_jis": "あいうえおかきくけこさしすせそたちつてとなにぬねのは",
    "gb18030": "的一是不了人我在有他这中大来上国个到说们为子和你地出",
}
_MARKS = re.compile("[\u0300-\u036f]")
_OTHERS = {kind: re.compile(f"[^\\x00-\\x7f{letters}]") for kind, letters in SCRIPTS.items()}
_WRITTEN = StructType([
    StructField("charset", StringType()), StructField("text", StringType()), StructField("content", BinaryType()),
])


@F.pandas_udf(_WRITTEN)
def _written(doc_ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """A document as bytes of a charset chosen by its id: Windows-1252 (UTF-8 where that cannot write it), or its
    letters, accents taken off, written in Cyrillic, kana or Hanzi and encoded in Windows-1251, Shift-JIS or GB18030."""
    rows = []
    for doc_id, text in zip(doc_ids, texts):
        text = text or ""
        kind = list(SCRIPTS)[doc_id % 4 - 1] if doc_id % 4 else None
        if kind is None:
            try:
                rows.append(("cp1252", text, text.encode("cp1252")))
            except UnicodeEncodeError:
                rows.append(("utf-8", text, text.encode()))
            continue
        plain = _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))
        plain = _OTHERS[kind].sub("", plain.translate(str.maketrans(LATIN_LETTERS, SCRIPTS[kind])))
        rows.append((kind, plain, plain.encode(kind)))
    return pd.DataFrame(rows, columns=["charset", "text", "content"])


def charset_detection(spark, sf_dir):
    """Documents written in four charsets and read back by detection: whether each text comes back whole."""
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", _written("doc_id", "text").alias("w"))
    read = docs.select("doc_id", "w", charsets.decode_detected(F.col("w.content")).alias("r"))
    return read.select(
        "doc_id", F.col("w.charset").alias("charset"), (F.col("r.text") == F.col("w.text")).alias("ok"),
    )


def decode_bytes(spark, sf_dir):
    latin = F.encode("text", "ISO-8859-1")
    content = F.when(F.col("text").rlike(r"\A[\x00-\xff]*\z"), latin).otherwise(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", X.decode_bytes(content).alias("text"))


# --- sets of rows ---------------------------------------------------------------------------------------------


def processed_anti(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id")
    return dedupe.not_stored(
        table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), done, "doc_id", check_size=True
    )


def upsert_latest(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    stored, batch = turns.where(F.col("turn") == 0), turns.where(F.col("turn") > 0)
    return dedupe.upsert(stored, batch, "conv_id", ["turn"], check_size=True)


def first_seen(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))
    return dedupe.keep_one(documents, "digest", ["doc_id"], check_size=True)


def union_messages(spark, sf_dir):
    """Mail and XML messages of one batch as one set of records."""
    parsed = mime.parse_mime(conversation_mail(table(spark, sf_dir, "conversations", heavy=True)))
    xml = M.xml_records(xml_messages.xml_messages(xml_messages.flatten_xml(customer_xml(spark, sf_dir))))
    return M.all_records(parsed, xml).select("external_id", "body")


def body_parts(spark, sf_dir):
    path = F.concat(
        F.lit("parts/"), F.col("conv_id"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 9, "0"), F.lit(".txt")
    )
    source = table(spark, sf_dir, "conversations", heavy=True).select(
        path.alias("path"), F.concat(F.lit("\n"), F.col("text"), F.lit(" \t")).cast("binary").alias("content")
    )
    bodies = parts.bodies_from_parts(parts.part_texts(source), 1000)
    return bodies.select(F.element_at(F.split("dir", "/"), -1).cast("bigint").alias("conv_id"), "body")


def attachments_top10(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 3 == 0, ".XML").otherwise(".pdf")
    path = F.concat(
        F.lit("mail/"), F.col("source"), F.lit(f"/{kinds.ATTACHMENT_DIR}/"), F.col("doc_id"), ending
    )
    source = table(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("size_bytes"))
    listed = parts.attachment_lists(source, 10)
    return listed.select("dir", F.inline("attachments")).select("dir", "filename", "size_bytes")


# --- vectors --------------------------------------------------------------------------------------------------


def vector_topk(spark, sf_dir):
    """The nearest vectors to that of row 0, as messages; hits without a message drop out."""
    embeddings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), "embedding")
    query = embeddings.where(F.col("message_id") == 0).first()["embedding"]
    found = search.semantic_search(document_messages(table(spark, sf_dir, "documents")), embeddings, query)
    numbered = _numbered(found, F.desc("score"), F.asc("message_id"))
    return numbered.withColumn("score", F.round("score", 6)).withColumn("sent_at", bare(F.col("sent_at")))


def vector_topk_many(spark, sf_dir):
    """Every vector whose id is divisible by 50 as a query against all vectors: the best TOP_K of each."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vector_search.top_k_many(embeddings.filter(F.col("vec_id") % 50 == 0), embeddings, vectors.TOP_K)
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


DIMENSIONS = 256


def hash_embed(spark, sf_dir):
    """The non-zero places of the stand-in embedding of every document."""
    encode = vectors.encode_column(lambda: vectors.hashing_encoder(DIMENSIONS))
    embedded = table(spark, sf_dir, "documents", heavy=True).select("doc_id", encode("text").alias("embedding"))
    places = embedded.select("doc_id", F.posexplode_outer("embedding").alias("place", "weight")).where(F.col("weight") != 0)
    return places.select("doc_id", F.col("place").cast("bigint"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


def semantic_text(spark, sf_dir):
    """Documents embedded from their excerpts and searched with an embedded query text."""
    messages = document_messages(table(spark, sf_dir, "documents", heavy=True))
    encode = vectors.encode_column(lambda: vectors.hashing_encoder(DIMENSIONS))
    embedded = messages.select("message_id", encode(X.excerpt(F.col("subject"), F.col("body"))).alias("embedding"))
    query = vectors.hashing_encoder(DIMENSIONS)(["thatin hehely ononst"])[0].tolist()
    hits = vectors.top_k(embedded, "message_id", query)
    return _numbered(hits, F.desc("score"), F.asc("message_id")).select(
        "pos", F.col("message_id").alias("doc_id"), F.round("score", 4).alias("score")
    )


# --- storing --------------------------------------------------------------------------------------------------


def csv_roundtrip(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", heavy=True)
    path = scratch_dir(spark, "csv")
    csv_export.write_csv(documents, path, null_value="\\N")
    return csv_export.read_csv(spark, path, documents.schema, null_value="\\N")


def store_batches(spark, sf_dir):
    """Two batches of conversation mail stored one after the other; the second repeats part of the first."""
    store = scratch_dir(spark, "store")
    turns = table(spark, sf_dir, "conversations", heavy=True)
    config = {"accounts": [{"name": "Users", "domains": ["example.com"], "aliases": ["user"], "partners": ["Que"]}]}
    for batch, rows in (("first", turns.where("turn < 2")), ("second", turns.where("turn >= 1"))):
        staged = f"{store}/staged/batch={batch}"
        ingest.stage(mime.parse_mime(conversation_mail(rows)), None, None, staged)
        ingest.store_batch(spark, staged, store, config, batch)
    return tables.table_counts(spark, store)


def table_counts(spark, sf_dir):
    """Given tables stored as the five tables, in one committed batch, and counted."""
    store = scratch_dir(spark, "counted")
    sources = {"messages": "documents", "attachments": "pages", "events": "events", "entities": "labels", "account_tags": "conversations"}
    for name, given in sources.items():
        first = table(spark, sf_dir, given)
        tables.write_batch(first.select(F.col(first.columns[0]).cast("bigint").alias("message_id")), store, name, "one")
    tables.commit(spark, store, "one", 0)
    return tables.table_counts(spark, store)


def flagship(spark, sf_dir):
    """Conversation mail parsed, tagged and shown as the dossier of one account."""
    parsed = mime.parse_mime(conversation_mail(table(spark, sf_dir, "conversations", heavy=True)))
    rules = tagging.Rules(accounts=(
        tagging.Account("Assistants", ("la",), (), ("Que",), ("de",)),
        tagging.Account("Users", (), ("example.com",), (), ()),
    ))
    messages = M.message_rows(M.complete(M.mail_records(parsed), rules))
    own = messages.where(F.col("account_tag") == "Assistants")
    newest = own.orderBy(F.desc("sent_at"), F.asc("external_id")).limit(search.DOSSIER_ROWS)
    return _numbered(newest, F.desc("sent_at"), F.asc("external_id")).select(
        "pos", "external_id", bare(F.col("sent_at")).alias("sent_at"), "sender_email", "subject",
        joined("partner_tags").alias("partner_tags"),
    )


QUERIES: dict[str, Query] = {
    "mime_roundtrip": mime_roundtrip,
    "message_record": message_record,
    "external_id": external_ids,
    "mail_dates": mail_dates,
    "mbox_ordinal": mbox_ordinal,
    "ics_events": ics_events,
    "zip_entries": zip_entries,
    "xml_messages": xml_message_rows,
    "xml_bodies": xml_bodies,
    "source_kind": source_kind,
    "tag_accounts": tag_accounts,
    "tag_rows": tag_rows,
    "tag_overrides": tag_overrides,
    "tag_many_accounts": tag_many_accounts,
    "entities_regex": entities_regex,
    "emails_distinct": emails_distinct,
    "keyword_search": keyword_search,
    "keyword_wildcard": keyword_wildcard,
    "keyword_boolean": keyword_boolean,
    "keyword_query_text": keyword_query_text,
    "keyword_query_all": keyword_query_all,
    "id_lookup": id_lookup,
    "id_lookup_reads": id_lookup_reads,
    "keyword_search_indexed": keyword_search_indexed,
    "keyword_wildcard_indexed": keyword_wildcard_indexed,
    "keyword_boolean_indexed": keyword_boolean_indexed,
    "keyword_index_reads": keyword_index_reads,
    "dossier": dossier,
    "timeline": timeline,
    "excerpt": excerpts,
    "html_to_text": html_to_text,
    "decode_bytes": decode_bytes,
    "charset_detection": charset_detection,
    "processed_anti": processed_anti,
    "upsert_latest": upsert_latest,
    "first_seen": first_seen,
    "union_messages": union_messages,
    "body_parts": body_parts,
    "attachments_top10": attachments_top10,
    "vector_topk": vector_topk,
    "vector_topk_many": vector_topk_many,
    "hash_embed": hash_embed,
    "semantic_text": semantic_text,
    "csv_roundtrip": csv_roundtrip,
    "store_batches": store_batches,
    "table_counts": table_counts,
    "mail_dossier": flagship,
    **RUNS,
}
