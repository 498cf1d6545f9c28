"""DuckDB SQL that gives the same rows as the query of the same name."""

from __future__ import annotations

from mailtables.functions.patterns import WHITESPACE

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def _strip(text: str) -> str:
    return f"trim({text}, {_BLANKS})"


_LINES = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
_CONV_TIME = "TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER)"

_EXTERNAL_ID = f"""
    CASE WHEN role <> 'system' THEN '<' || conv_id || '.' || turn || '@example.com>'
         ELSE sha1(role || '@example.com' || strftime({_CONV_TIME}, '%a, %d %b %Y %H:%M:%S +0000')
                   || 'Conversation ' || conv_id) END
"""
_CONV_EXCERPT = f"'Conversation ' || conv_id || chr(10) || chr(10) || {_strip(_LINES)}"

# The entity patterns.
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_DATE = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
_MONEY = r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b"

_DOCUMENT_MESSAGES = """
    SELECT doc_id AS message_id, source || ' in ' || lang AS subject, text AS body,
           source || '@' || lang || '.example.com' AS sender_email, source AS account_tag,
           TIMESTAMP '2024-01-01' + to_minutes(doc_id::INTEGER) AS sent_at
    FROM documents
"""

_TAGGED_DOCUMENTS = """
    WITH words AS (
        SELECT doc_id, lower(source || ' in ' || lang || chr(10) || text) AS t,
               lower(source || '@' || lang || '.example.com' || chr(10) || 'Desk@' || source || '.example.net') AS a
        FROM documents
    ), scored AS (
        SELECT doc_id,
            (contains(t, 'thatin') OR contains(t, 'hehely'))::INT + (contains(t, 'thing') OR contains(t, 'attion'))::INT
                + 2 * contains(a, '@de.example.com')::INT AS s1,
            contains(t, 'ononst')::INT + (contains(t, 'thble') OR contains(t, 'ering'))::INT
                + 2 * contains(a, '@src7.example.net')::INT AS s2,
            (contains(t, 'nicht') OR contains(t, 'ensch'))::INT + contains(t, 'enung')::INT
                + 2 * (contains(a, '@fr.example.com') OR contains(a, '@es.example.com'))::INT AS s3,
            contains(t, 'erble')::INT + (contains(t, 'retion') OR contains(t, 'oning'))::INT
                + 2 * contains(a, '@src3.example.net')::INT AS s4,
            list_filter(['Ononst', 'Orantion', 'Thatin', 'Erble', 'Queci'], lambda p: contains(t, lower(p))) AS partners
        FROM words
    ), tagged AS (
        SELECT doc_id, partners,
            CASE WHEN s1 >= 2 THEN 'Thatin' WHEN s2 >= 2 THEN 'Ononst' WHEN s3 >= 2 THEN 'Nicht'
                 WHEN s4 >= 2 THEN 'Erble' END AS account_tag
        FROM scored
    )
"""


def _search(condition: str, limit: int | None = 50) -> str:
    return f"""
        SELECT row_number() OVER (ORDER BY sent_at DESC NULLS LAST, message_id) AS pos, message_id, sent_at,
               sender_email, account_tag, left(subject, 80) AS subject
        FROM ({_DOCUMENT_MESSAGES}) WHERE {condition}
        ORDER BY sent_at DESC NULLS LAST, message_id {'' if limit is None else f'LIMIT {limit}'}
    """


def _fold(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _holds(*grams: str) -> str:
    """Every trigram occurs in the folded subject (fs) or body (fb): what the substring index answers."""
    return "(" + " AND ".join(f"(contains(fs, '{g}') OR contains(fb, '{g}'))" for g in grams) + ")"


def _like(word: str) -> str:
    return f"({_fold('subject')} LIKE '%{word}%' OR {_fold('body')} LIKE '%{word}%')"


def _located(label: str, pattern: str) -> str:
    return f"""
        SELECT message_id, '{label}' AS label, found[i] AS text,
               coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
                 + coalesce(list_sum(list_transform(found[1:i-1], lambda m: length(m))), 0) AS start_char
        FROM (SELECT message_id, regexp_extract_all(body, '{pattern}') AS found,
                     regexp_split_to_array(body, '{pattern}') AS gaps FROM texts), unnest(range(1, len(found) + 1)) r(i)
    """


def _embedding(texts: str) -> str:
    """Long form of the stand-in embedding of rows (id, text)."""
    return f"""
        WITH spots AS (
            SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 256 AS place
            FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM ({texts}))
        ), counts AS (SELECT id, place, count(*) AS n FROM spots GROUP BY ALL)
        SELECT id, place, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS weight FROM counts
    """



ORACLES: dict[str, str] = {
    "mime_roundtrip": f"""
        SELECT conv_id, turn, role || '@example.com' AS sender_email,
               'desk@example.org;desk2@example.org' AS recipients_to,
               CASE WHEN turn % 2 = 1 THEN 'audit@example.org' ELSE '' END AS recipients_cc,
               'Conversation ' || conv_id AS subject, {_LINES} AS body, {_CONV_TIME} AS sent_at,
               NULL::VARCHAR AS error
        FROM conversations
    """,
    "message_record": f"""
        WITH mail AS (
            SELECT *, {_CONV_TIME} AS made, 'Conversation ' || conv_id AS subject FROM conversations
        )
        SELECT CASE WHEN role <> 'system' THEN '<' || conv_id || '.' || turn || '@example.com>'
                    ELSE sha1(role || '@example.com' || strftime(made, '%a, %d %b %Y %H:%M:%S +0000') || subject)
               END AS external_id,
               'topic-' || conv_id AS thread_id, NULL::VARCHAR AS folder, role || '@example.com' AS sender_name,
               role || '@example.com' AS sender_email, 'desk@example.org;desk2@example.org' AS recipients_to,
               CASE WHEN turn % 2 = 1 THEN 'audit@example.org' ELSE '' END AS recipients_cc, '' AS recipients_bcc,
               subject, {_LINES} AS body, strftime(made, '%Y-%m-%dT%H:%M:%SZ') AS sent_at,
               strftime(made, '%Y-%m-%dT%H:%M:%SZ') AS received_at, 0 AS is_read, 0 AS has_attachments,
               NULL::VARCHAR AS account_tag, '' AS partner_tags, NULL::VARCHAR AS raw_headers
        FROM mail
    """,
    "external_id": """
        SELECT conv_id, turn, CASE WHEN role = 'user' THEN '<' || conv_id || '.' || turn || '@x>'
                                   ELSE sha1(role || text) END AS external_id
        FROM conversations
    """,
    "mail_dates": """
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate - INTERVAL 150 MINUTE END AS sent_at
        FROM orders
    """,
    "mbox_ordinal": rf"""
        SELECT conv_id, turn,
               row_number() OVER (PARTITION BY conv_id // 100, turn // 1000 ORDER BY conv_id, turn) - 1 AS position,
               length(rtrim({_LINES}, chr(10))) AS chars
        FROM conversations
    """,
    "ics_events": """
        SELECT 'calendar' AS kind, event_type || ' of  user ' || user_id AS title,
               date_trunc('second', ts) AS starts_at, date_trunc('second', ts) + INTERVAL 30 MINUTE AS ends_at,
               props AS location
        FROM events
    """,
    "zip_entries": "SELECT doc_id, octet_length(encode(text)) AS size_bytes, sha1(text) AS digest FROM documents",
    "xml_messages": """
        SELECT 'xml/' || c_custkey || '/message.xml' AS path,
               sha1('xml/' || c_custkey || '/message.xml' || c_name) AS external_id, c_name AS subject,
               'Segment ' || c_mktsegment AS body,
               CASE WHEN c_custkey % 3 = 2 THEN 'a@example.org' ELSE 'c' || c_custkey || '@example.com' END
                   AS sender_email,
               'a@example.org;c' || c_custkey || '@example.com' AS recipients_to,
               TIMESTAMP '2024-01-02 02:04:05' AS sent_at
        FROM customer WHERE c_acctbal >= 0
    """,
    "xml_bodies": rf"""
        WITH parts AS (
            SELECT o_custkey, lpad(o_orderkey::VARCHAR, 12, '0') || '.com_0001' AS name,
                   'Order ' || o_orderkey || chr(10) || o_orderpriority AS piece
            FROM orders
        ), sums AS (
            SELECT *, sum(length(piece)) OVER (PARTITION BY o_custkey ORDER BY name
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM parts
        ), bodies AS (
            SELECT o_custkey, left(string_agg(piece, chr(10) || chr(10) ORDER BY name), 200) AS body
            FROM sums WHERE coalesce(before, 0) < 200 GROUP BY 1
        ), files AS (
            SELECT o_custkey, o_orderkey, o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '.xml' ELSE '.pdf' END AS name
            FROM orders
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY name) AS n FROM files
        ), attached AS (
            SELECT o_custkey, string_agg(name || ':' || o_orderkey, ';' ORDER BY name) AS attachments
            FROM ranked WHERE n <= 10 AND name NOT LIKE '%.xml' GROUP BY 1
        )
        SELECT 'xml/' || c_custkey || '/message.xml' AS path, c_name AS subject, body,
               coalesce(attachments, '') AS attachments
        FROM customer LEFT JOIN bodies b ON b.o_custkey = c_custkey LEFT JOIN attached a ON a.o_custkey = c_custkey
    """,
    "source_kind": r"""
        SELECT page_id, CASE
            WHEN page_id % 25 = 24 THEN 'missing'
            WHEN page_id % 12 IN (0, 1) THEN 'eml' WHEN page_id % 12 = 2 THEN 'mbox' WHEN page_id % 12 = 3 THEN 'emlx'
            WHEN page_id % 12 = 4 THEN 'ics' WHEN page_id % 12 = 5 THEN 'xml' WHEN page_id % 12 = 7 THEN 'zip'
            WHEN page_id % 12 = 8 THEN 'pst' WHEN page_id % 12 = 9 THEN 'olm'
            WHEN page_id % 2 = 0 THEN 'zip' ELSE 'unsupported' END AS source_kind
        FROM pages
    """,
    "tag_accounts": f"""{_TAGGED_DOCUMENTS}
        SELECT doc_id, account_tag, array_to_string(partners, ';') AS partner_tags FROM tagged
    """,
    "tag_rows": f"""{_TAGGED_DOCUMENTS}
        SELECT doc_id, account_tag AS tag, 'account' AS kind FROM tagged WHERE account_tag IS NOT NULL
        UNION ALL SELECT doc_id, unnest(partners) AS tag, 'partner' AS kind FROM tagged
    """,
    "tag_many_accounts": """
    WITH syl AS (
        SELECT ['th', 'at', 'in', 'on', 'er', 'an', 're', 'en', 'st', 'he', 'ble', 'tion'] AS s
    ), accounts AS (
        SELECT c_custkey AS place, c_name AS name,
            s[c_custkey % 12 + 1] || s[(c_custkey // 12) % 12 + 1] || s[(c_custkey // 144) % 12 + 1] AS alias,
            s[(c_custkey * 5 + 3) % 12 + 1] || s[((c_custkey * 5 + 3) // 12) % 12 + 1]
                || s[((c_custkey * 5 + 3) // 144) % 12 + 1] AS keyword,
            s[(c_custkey * 3 + 1) % 12 + 1] || s[((c_custkey * 3 + 1) // 12) % 12 + 1]
                || s[((c_custkey * 3 + 1) // 144) % 12 + 1] AS partner,
            '@src' || (c_custkey % 20) || '.example.net' AS domain
        FROM customer, syl
    ), partners AS (
        SELECT upper(left(partner, 1)) || substr(partner, 2) AS partner, min(place) AS first FROM accounts GROUP BY 1
    ), words AS (
        SELECT doc_id, lower(source || ' in ' || lang || chr(10) || text) AS t,
               lower(source || '@' || lang || '.example.com' || chr(10) || 'Desk@' || source || '.example.net') AS a
        FROM documents
    ), scored AS (
        SELECT doc_id, min(place) FILTER (
            WHERE contains(t, alias)::INT + contains(t, keyword)::INT + 2 * contains(a, domain)::INT >= 2) AS place
        FROM words, accounts GROUP BY doc_id
    ), named AS (
        SELECT doc_id, string_agg(partner, ';' ORDER BY first) AS partner_tags
        FROM words, partners WHERE contains(t, lower(partner)) GROUP BY doc_id
    )
    SELECT w.doc_id, a.name AS account_tag, coalesce(n.partner_tags, '') AS partner_tags
    FROM words w LEFT JOIN scored s USING (doc_id) LEFT JOIN accounts a ON a.place = s.place
        LEFT JOIN named n ON n.doc_id = w.doc_id
    """,
    "tag_overrides": r"""
        WITH pages2 AS (
            SELECT *, contains(url, 'utm_source') AS feed, CASE
                WHEN page_id = 7 THEN 'Seven' WHEN page_id = 11 THEN 'Eleven'
                WHEN regexp_matches(url, '(?i)SPAM.farm') THEN 'Spam'
                WHEN regexp_matches(url, '/en/\d+\.html') THEN 'English' END AS override,
                CASE WHEN contains(url, '//blog.') THEN 'Blogs'
                     WHEN contains(lower(url), 'example.net') AND contains(lower(url), '/en/') THEN 'Net' END AS account
            FROM pages
        )
        SELECT page_id, coalesce(override, account) AS account_tag,
               CASE WHEN override IS NULL AND feed THEN 'Feed' ELSE '' END AS partner_tags
        FROM pages2
    """,
    "entities_regex": f"""
        WITH texts AS (
            SELECT 'd' || doc_id AS message_id, text AS body FROM documents
            UNION ALL
            SELECT 'o' || o_orderkey, 'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d')
                || ' (due ' || strftime(o_orderdate, '%-m/%-d/%y') || '): $'
                || format('{{:,.2f}}', o_totalprice) || ', écrire à c' || o_custkey
                || '@example.com 😀 or sales@example.com.'
            FROM orders
        )
        SELECT *, start_char + length(text) AS end_char
        FROM ({_located('EMAIL', _EMAIL)} UNION ALL {_located('DATE', _DATE)} UNION ALL {_located('MONEY', _MONEY)})
    """,
    "emails_distinct": f"""
        SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_EMAIL}'))), ';') AS emails
        FROM documents
    """,
    "keyword_search": _search(_like("hehely")),
    "keyword_wildcard": _search(_like("the%on_nst"), 100),
    "keyword_boolean": _search(
        f"{_like('the')} AND ({_like('thatin')} OR {_like('hehely')}) AND NOT {_like('ononst')}"
    ),
    "keyword_query_text": _search(
        f"{_like('thatin')} AND ({_like('hehely')} OR {_like('ononst')}) AND NOT {_like('ering ou')}"
    ),
    "id_lookup": """
        SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    """,
    "keyword_query_all": _search(
        f"{_like('thatin')} AND ({_like('hehely')} OR {_like('ononst')}) AND NOT {_like('ering ou')}", None
    ),
    "keyword_search_indexed": _search(_like("hehely")),
    "keyword_wildcard_indexed": _search(_like("the%on_nst"), 100),
    "keyword_boolean_indexed": _search(
        f"{_like('the')} AND ({_like('thatin')} OR {_like('hehely')}) AND NOT {_like('ononst')}"
    ),
    "keyword_index_reads": f"""
        WITH m AS ({_DOCUMENT_MESSAGES}), f AS (
            SELECT *, {_fold("coalesce(subject, '')")} AS fs, {_fold("coalesce(body, '')")} AS fb FROM m
        )
        SELECT '(all messages)' AS search, count(*) AS bodies_read, NULL::BIGINT AS hits FROM m
        UNION ALL
        SELECT 'HeHely', count(*), count(*) FILTER (WHERE {_like('hehely')})
        FROM f WHERE {_holds('heh', 'ehe', 'hel', 'ely')}
        UNION ALL
        SELECT 'the%on_nst', count(*), count(*) FILTER (WHERE {_like('the%on_nst')})
        FROM f WHERE {_holds('the', 'nst')}
        UNION ALL
        SELECT 'the AND (thatin OR hehely) AND NOT ononst', count(*),
            count(*) FILTER (WHERE {_like('the')} AND ({_like('thatin')} OR {_like('hehely')}) AND NOT {_like('ononst')})
        FROM f WHERE {_holds('the')} AND ({_holds('tha', 'hat', 'ati', 'tin')} OR {_holds('heh', 'ehe', 'hel', 'ely')})
    """,
    "dossier": """
        SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos, o_orderkey AS message_id,
               o_orderdate AS sent_at, c_name AS sender_email, o_orderpriority AS subject
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 500
    """,
    "timeline": """
        SELECT event_id AS message_id, props AS subject, 'user-' || user_id || '@example.com' AS sender_email,
               ts AS sent_at
        FROM events WHERE event_type = 'error' ORDER BY ts, event_id
    """,
    "excerpt": f"""
        SELECT doc_id, left(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END || chr(10) || chr(10)
                            || {_strip('text')}, 2000) AS excerpt
        FROM documents
    """,
    "html_to_text": r"""
        SELECT page_id,
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(trim(regexp_replace(html,
                    '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*(?:>|\z).*?(?:</script\s*>|\z)|<style\b[^>]*(?:>|\z).*?(?:</style\s*>|\z)|<template\b[^>]*(?:>|\z).*?(?:</template\s*>|\z)|<[a-z/!?][^>]*(?:>|\z)',
                    chr(1), 'g'), chr(1)), '\x01+', chr(10), 'g'),
                '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g') AS text
        FROM pages
    """,
    "decode_bytes": "SELECT doc_id, text FROM documents",
    # every text comes back whole: the charset that wrote it, its length in bytes, and true
    "charset_detection": r"""
        SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'cp1251' WHEN 2 THEN 'shift_jis' WHEN 3 THEN 'gb18030'
                ELSE CASE WHEN regexp_matches(coalesce(text, ''), '[^\x00-\x7f\xa0-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]')
                    THEN 'utf-8' ELSE 'cp1252' END
            END AS charset, true AS ok
        FROM documents
    """,
    "processed_anti": """
        SELECT doc_id, source, n_chars FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    """,
    "upsert_latest": """
        SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations
        WHERE turn >= 0 GROUP BY conv_id
    """,
    "first_seen": "SELECT min(doc_id) AS doc_id, sha1(text) AS digest FROM documents GROUP BY sha1(text)",
    "union_messages": f"""
        SELECT {_EXTERNAL_ID} AS external_id, {_LINES} AS body FROM conversations
        UNION ALL SELECT sha1('xml/' || c_custkey || '/message.xml' || c_name), 'Segment ' || c_mktsegment
        FROM customer WHERE c_acctbal >= 0
    """,
    "incremental_ingest": f"""
        SELECT {_EXTERNAL_ID} AS external_id, CASE WHEN turn = 0 THEN 'one' ELSE 'two' END AS batch FROM conversations
    """,
    "ingest_errors": "SELECT c_custkey, 'xml' AS stage FROM customer WHERE c_acctbal < 0",
    "event_batches": """
        SELECT event_id, date_trunc('second', ts) AS starts_at, props AS location FROM events
    """,
    "emlx_attachments": """
        SELECT doc_id, 'J\u00fcrgen <j@x.example>' AS sender_name, source || ' in ' || lang || ' \u00e9t\u00e9' AS subject,
               text AS body, true AS has_attachments, 'd' || doc_id || '.pdf' AS filename,
               'application/pdf' AS content_type, octet_length(encode(lang)) AS size_bytes
        FROM documents
    """,
    "stream_days": f"""
        SELECT {_EXTERNAL_ID} AS external_id, CASE WHEN turn = 0 THEN 'mail-0' ELSE 'mail-1' END AS batch,
               {_CONV_EXCERPT} AS excerpt, 16 AS dims
        FROM conversations
    """,
    "embeddings_store": f"""
        SELECT {_EXTERNAL_ID} AS external_id, 'on' AS feature, {_CONV_EXCERPT} AS excerpt FROM conversations
    """,
    "model_entities": """
        SELECT doc_id, 'HEAD' AS label, left(text, 5) AS text, 0 AS start_char, length(left(text, 5))::INT AS end_char
        FROM documents WHERE text <> ''
    """,
    "body_parts": f"""
        WITH sums AS (
            SELECT conv_id, turn, {_strip('text')} AS piece, sum(length(text) + 3) OVER (
                PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM conversations
        )
        SELECT conv_id, left(string_agg(piece, chr(10) || chr(10) ORDER BY turn), 1000) AS body
        FROM sums WHERE coalesce(before, 0) < 1000 AND piece <> '' GROUP BY conv_id
    """,
    "attachments_top10": """
        WITH named AS (
            SELECT 'mail/' || source AS dir, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.XML' ELSE '.pdf' END AS filename,
                   n_chars AS size_bytes
            FROM documents
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY filename) AS n FROM named)
        SELECT dir, filename, size_bytes FROM ranked WHERE n <= 10 AND filename NOT LIKE '%.XML'
    """,
    "vector_topk_many": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), q AS (
            SELECT * FROM v WHERE vec_id % 50 = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
            FROM q JOIN v ON len(v.e) = (SELECT len(e) FROM q ORDER BY vec_id LIMIT 1) AND len(q.e) = len(v.e)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
    """,
    "vector_topk": f"""
        WITH hits AS (
            SELECT vec_id, list_inner_product(embedding::DOUBLE[],
                       (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s
            FROM embeddings ORDER BY s DESC, vec_id LIMIT 10
        )
        SELECT row_number() OVER (ORDER BY s DESC, message_id) AS pos, message_id, round(s, 6) AS score,
               printf('%.3f', s) AS shown_score, sent_at, sender_email, subject, account_tag
        FROM hits JOIN ({_DOCUMENT_MESSAGES}) ON message_id = vec_id
    """,
    "hash_embed": f"""
        SELECT id AS doc_id, place, round(weight, 5) AS weight
        FROM ({_embedding('SELECT doc_id AS id, text FROM documents')})
    """,
    "semantic_text": f"""
        WITH texts AS (
            SELECT message_id AS id, {_strip('subject')} || chr(10) || chr(10) || {_strip('body')} AS text
            FROM ({_DOCUMENT_MESSAGES})
        ), e AS ({_embedding('SELECT * FROM texts')}),
        q AS ({_embedding("SELECT 0 AS id, 'thatin hehely ononst' AS text")}),
        scores AS (
            SELECT t.id AS doc_id, coalesce(sum(e.weight * q.weight), 0) AS s
            FROM texts t LEFT JOIN e ON e.id = t.id LEFT JOIN q ON q.place = e.place GROUP BY 1
        )
        SELECT row_number() OVER (ORDER BY s DESC, doc_id) AS pos, doc_id, round(s, 4) AS score
        FROM scores ORDER BY s DESC, doc_id LIMIT 10
    """,
    "csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "store_batches": f"""
        WITH mail AS (
            SELECT role, 'conversation ' || conv_id || chr(10) || lower({_LINES}) AS t, {_LINES} AS body FROM conversations
        )
        SELECT 'messages' AS table_name, count(*) AS row_count FROM mail
        UNION ALL SELECT 'attachments', 0
        UNION ALL SELECT 'events', 0
        UNION ALL SELECT 'entities', coalesce(sum(len(regexp_extract_all(body, '{_EMAIL}'))
            + len(regexp_extract_all(body, '{_DATE}')) + len(regexp_extract_all(body, '{_MONEY}'))), 0)::BIGINT FROM mail
        UNION ALL SELECT 'account_tags', sum(1 + contains(t, 'que')::INT)::BIGINT FROM mail
    """,
    "table_counts": """
        SELECT 'messages' AS table_name, count(*) AS row_count FROM documents
        UNION ALL SELECT 'attachments', count(*) FROM pages
        UNION ALL SELECT 'events', count(*) FROM events
        UNION ALL SELECT 'entities', count(*) FROM labels
        UNION ALL SELECT 'account_tags', count(*) FROM conversations
    """,
    "mail_dossier": f"""
        WITH mail AS (
            SELECT *, {_CONV_TIME} AS made, 'Conversation ' || conv_id AS subject,
                   lower('Conversation ' || conv_id || chr(10) || {_LINES}) AS t
            FROM conversations
        ), own AS (
            SELECT CASE WHEN role <> 'system' THEN '<' || conv_id || '.' || turn || '@example.com>'
                        ELSE sha1(role || '@example.com' || strftime(made, '%a, %d %b %Y %H:%M:%S +0000') || subject)
                   END AS external_id, made AS sent_at, role || '@example.com' AS sender_email, subject,
                   CASE WHEN contains(t, 'que') THEN 'Que' ELSE '' END AS partner_tags
            FROM mail WHERE contains(t, 'la') AND contains(t, 'de')
        )
        SELECT row_number() OVER (ORDER BY sent_at DESC, external_id) AS pos, *
        FROM own ORDER BY sent_at DESC, external_id LIMIT 500
    """,
}
