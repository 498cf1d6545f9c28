"""DuckDB SQL for the queries of this package that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"


def _shuffled(seed: str, value: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || coalesce({value}::varchar, '')), 1, 15))::bigint"


OP1 = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint AS size,
    {_shuffled('mix', 'doc_id')} AS shuffled, coalesce(doc_id::varchar, '') AS id
  FROM documents
), named AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS queue
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((queue - 1) % 3 + 1)::int] AS weight, source_size * 2 AS most,
    sum(source_size) OVER () * 1.5::double AS budget
  FROM named
), levels AS (
  SELECT *, most::double / weight AS dry,
    (budget - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))
      AS level
  FROM weighed
  WINDOW before AS (ORDER BY most::double / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sources AS (
  SELECT *, least(coalesce(weight * (SELECT l.level FROM levels l WHERE l.level <= l.dry ORDER BY dry, queue LIMIT 1),
    most), most)::double AS target
  FROM levels
), queued AS (
  SELECT d.*, s.source_size, s.target, s.queue, s.weight, s.budget,
    sum(d.size) OVER (PARTITION BY queue ORDER BY shuffled, id, size ROWS UNBOUNDED PRECEDING)::bigint AS total
  FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), entries AS (
  SELECT q.*, copy, (source_size * copy + total)::double / weight AS finish
  FROM queued q, (VALUES (0), (1)) c(copy)
), fitted AS (
  SELECT *, sum(size) OVER (ORDER BY finish, queue, copy, shuffled, id, size ROWS UNBOUNDED PRECEDING) <= budget AS fits
  FROM entries
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN fits THEN size ELSE 0 END)::bigint AS taken
FROM fitted GROUP BY doc_id, id, source, size, total, source_size, target
"""

_CRC_TABLE = """bits(byte, crc, step) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL
  SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(crc ORDER BY byte) AS entries FROM bits WHERE step = 8
)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, with `entries` of _CRC_TABLE in scope."""
    return f"""xor(4294967295, list_reduce(
      list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::bigint))"""


OP5 = f"""
WITH RECURSIVE {_CRC_TABLE}, sizes AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::bigint + 1 AS size,
    xor(4294967295, list_reduce(
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::bigint)) AS text_crc32,
    {_shuffled('shard', 'doc_id')} AS shuffled, coalesce(doc_id::varchar, '') AS id,
    {_shuffled('shard-source', 'source')} / 1152921504606846976::double AS phase
  FROM documents, crc_table
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffled, id, size, text_crc32) - 1 + phase)
    / count(*) OVER (PARTITION BY source) AS fraction
  FROM sizes
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, shuffled, id, size, text_crc32) - 1 AS place, count(*) OVER () AS n
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 16 // n)::int AS shard,
  (place - ((place * 16 // n) * n + 15) // 16)::bigint AS slot, NULL::int AS grown_shard
FROM placed
"""

OP2 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.ints::double[], v.ints::double[])::bigint AS score
  FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP6 = f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '{_WORD}') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3
      THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: hash(array_to_string(ws[i:i + 2], ' '))))
      WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END AS shingles
  FROM doc_words
), rows AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n + b.n) AS total
  FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (total - shared)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(start, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT start, b FROM reached JOIN ways ON a = node
)
SELECT doc_id, len(shingles)::bigint AS n_shingles, component_id
FROM sets JOIN (SELECT start AS doc_id, min(node) AS component_id FROM reached GROUP BY 1) USING (doc_id)
"""

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH item_words AS (
  SELECT coalesce(item_id::varchar, '') AS item,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_PLAIN}') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS phrase, least(13, len(ws)) AS n
  FROM (SELECT *, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM item_words WHERE len(ws) > 0)
), doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_PLAIN}') AS ws
  FROM documents
), runs AS (
  SELECT row_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (
    SELECT row_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n
  )
), hits AS (
  SELECT row_id, item, i, r.n FROM runs r JOIN windows w ON r.phrase = w.phrase AND r.n = w.n
), hit_words AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), hit_items AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY 1
)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""

OP10 = """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::bigint AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page
  FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM firsts
"""


def _later_copies(units: str, joined: str, count: str, removed_runs: str, words: str = "1", least: int = 0) -> str:
    """Units of documents that lie in a run of three which another place has before it."""
    return f"""
WITH whole AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), listed AS (
  {units}
), each AS (
  SELECT doc_id, i, raw[i] AS raw, name[i] AS name FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM listed)
), runs AS (
  SELECT doc_id, i, name || chr(1) || lead(name, 1) OVER w || chr(1) || lead(name, 2) OVER w AS run FROM each
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS later FROM runs
  WHERE run IS NOT NULL AND {words} >= {least}
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM counted, (VALUES (0), (1), (2)) t(k) WHERE later
), marked AS (
  SELECT e.*, g.i IS NOT NULL AS gone, coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY e.doc_id ORDER BY e.i), false) AS before
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
)
SELECT doc_id, count(i)::bigint AS {count}, coalesce(sum(gone::int), 0)::bigint AS n_removed,
  coalesce(sum((gone AND NOT before)::int), 0)::bigint AS {removed_runs},
  sha256(coalesce(string_agg(raw, {joined} ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM whole LEFT JOIN marked USING (doc_id) GROUP BY doc_id
"""


OP3 = _later_copies(
    "SELECT doc_id, string_split(text, chr(10)) AS raw, string_split(text, chr(10)) AS name FROM whole",
    "chr(10)", "n_lines", "n_runs",
)
_END = r"[.!?]+[\x20\t\r\n\f]+|\n[\x20\t\r\n\f]*"
OP7 = _later_copies(
    f"""SELECT doc_id, raw, list_transform(raw, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS name FROM (
    SELECT doc_id, list_filter(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(ends[i], '')),
      lambda x: x <> '') AS raw
    FROM (
      SELECT doc_id, regexp_split_to_array(text, '{_END}') AS parts, regexp_extract_all(text, '{_END}') AS ends FROM whole
    )
  )""",
    "''", "n_sentences", "n_spans", "len(regexp_extract_all(run, '[^ \\x01]+'))", 12,
)

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11 = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::varchar, '') AS owner, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), hashed AS (
  SELECT low, {_crc32("owner || ':' || low")} AS h
  FROM (SELECT owner, translate(run, {_AZ}) AS low FROM runs WHERE length(run) >= 7), crc_table
), edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(low, 1, (h % length(low))::int) || substring(low, (h % length(low))::int + 2)
    ELSE low END AS word
  FROM hashed
), words AS (
  SELECT word, count(*)::bigint AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), dels AS (
  SELECT word, n, i, substring(word, 1, i::int) || substring(word, i::int + 2) AS del
  FROM (SELECT word, n, unnest(range(length(word)::bigint)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM dels a JOIN dels b ON a.i = b.i AND a.del = b.del AND a.word <> b.word
  UNION
  SELECT a.word, w.word, w.n FROM dels a JOIN words w ON a.del = w.word
  UNION
  SELECT w.word, a.word, a.n FROM dels a JOIN words w ON a.del = w.word
), best AS (
  SELECT word, count(*)::bigint AS n_near, first(other ORDER BY other_n DESC, other) AS other,
    max(other_n) AS other_n
  FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::bigint AS n_near,
    CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
    CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END::bigint AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain(word, root, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r USING (word)
"""

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE}, t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL
), lens AS (
  SELECT conv_id, count(*) AS len FROM t GROUP BY conv_id
), hs AS (
  SELECT conv_id AS c, {_crc32("conv_id::varchar")} % 9 AS h, conv_id - conv_id % 5 AS p FROM lens, crc_table
), rebuilt AS (
  SELECT hs.c, t.k AS j, t.role, t.text FROM hs JOIN t ON t.conv_id = hs.p AND t.k < hs.h
  UNION ALL
  SELECT hs.c, least(hs.h, coalesce(l.len, 0)) + t.k - hs.h AS j, t.role, t.text
  FROM hs JOIN t ON t.conv_id = hs.c AND t.k >= hs.h LEFT JOIN lens l ON l.conv_id = hs.p
), paths AS (
  SELECT hs.c, coalesce(r.path, []) AS path FROM hs LEFT JOIN (
    SELECT c, list({{'r': role, 't': text}} ORDER BY j) AS path FROM rebuilt GROUP BY c
  ) r USING (c)
), members AS (
  SELECT c, d, len(path) AS l, list_slice(path, 1, d) AS prefix,
    CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(path[d].t)) END AS b
  FROM (SELECT c, path, unnest(range(len(path)::bigint + 1)) AS d FROM paths)
), nodes AS (
  SELECT prefix, d AS depth, min(c) AS conv_id, count(*)::bigint AS n_convs, max(b) AS b,
    sha256(coalesce(string_agg(CASE WHEN l = d THEN c::varchar END, ',' ORDER BY c), '')) AS ends_sha256
  FROM members GROUP BY prefix, d
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes ch WHERE ch.depth = n.depth + 1 AND list_slice(ch.prefix, 1, n.depth) = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
)
SELECT x.conv_id, x.depth, x.parent_conv_id, x.n_convs, x.n_children::bigint AS n_children,
  count(*) FILTER (WHERE y.n_children = 0)::bigint AS n_leaves, sum((y.n_convs - 1) * y.b)::bigint AS saved_tokens,
  x.ends_sha256
FROM linked x JOIN linked y ON y.depth >= x.depth AND list_slice(y.prefix, 1, x.depth) = x.prefix
GROUP BY x.conv_id, x.depth, x.parent_conv_id, x.n_convs, x.n_children, x.ends_sha256
"""

ORACLES: dict[str, str] = {
    "op1_mixing": OP1,
    "op2_topk": OP2,
    "op3_line_dedup": OP3,
    "op5_sharding": OP5,
    "op6_jaccard": OP6,
    "op7_sentence_spans": OP7,
    "op9_decontamination": OP9,
    "op10_warc": OP10,
    "op11_spelling": OP11,
    "op12_prefix_trie": OP12,
}
