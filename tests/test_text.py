import html
import re
import sqlite3

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailtables.functions import patterns, text as X, times
from mailtables.functions.ids import external_id
from mailtables.operators.entities import add_entities
from mailtables.sources.xml_messages import distinct_emails

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))

PIECES = st.sampled_from(
    ["a@b.co", "x.y+z@mail-1.example.org", "@", "a@b.c1@d.org", "2024-01-05", "1/2/24", "12/31/2024", "3/4/2", "$5",
     "$ 1,234.50", "$1234", "$12.5", "٣/٤/٢٠٢٤", "١٢٣٤-٠١-٠٢", "²", "é", "😀", "_", " ", " ", "\x1c", "\n", ".",
     "abc", "7", "-", "é", "%"]
)
TEXTS = st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=60)


def column(spark, values, name="body"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} string").repartition(1)


def python_entities(text):
    kinds = [("EMAIL", patterns.EMAIL), ("DATE", patterns.DATE), ("MONEY", patterns.MONEY)]
    return [(label, m[0], m.start(), m.end()) for label, p in kinds for m in re.finditer(p, text)]


@SLOW
@given(values=TEXTS)
def test_entities_equal_python(spark, values):
    rows = add_entities(column(spark, values)).select("id", "entities").collect()
    for row in rows:
        assert [tuple(e) for e in row.entities] == python_entities(values[row.id])


def test_entities_of_null_and_of_many_matches(spark):
    many = " ".join(f"u{i}@example.com" for i in range(2500))
    rows = add_entities(column(spark, [None, many])).orderBy("id").collect()
    assert rows[0].entities == []
    assert [tuple(e) for e in rows[1].entities] == python_entities(many)


def test_long_run_without_an_address_is_linear(spark):
    rows = add_entities(column(spark, ["A" * 2_000_000 + " b@c.org @"])).collect()
    assert [e.text for e in rows[0].entities] == ["b@c.org"]


def test_entity_model_comes_first(spark):
    import pandas as pd

    from mailtables.schema import ENTITY

    @F.pandas_udf(f"array<{ENTITY}>")
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"label": "LEN", "text": t, "start_char": 0, "end_char": len(t)}])

    rows = add_entities(column(spark, ["on 2024-01-05"]), model=model).collect()
    assert [e.label for e in rows[0].entities] == ["LEN", "DATE"]


@SLOW
@given(values=TEXTS)
def test_distinct_emails_keep_order(spark, values):
    rows = column(spark, values).select("id", distinct_emails(F.array("body")).alias("e")).collect()
    for row in rows:
        assert row.e == list(dict.fromkeys(re.findall(patterns.EMAIL, values[row.id])))


@SLOW
@given(values=st.lists(st.text(alphabet=st.sampled_from(patterns.WHITESPACE + "ab​"), max_size=9), min_size=1))
def test_strip_and_excerpt_equal_python(spark, values):
    rows = column(spark, values).select(
        "id", X.strip(F.col("body")).alias("s"), X.excerpt(F.lit(None).cast("string"), F.col("body")).alias("x")
    ).collect()
    for row in rows:
        assert row.s == values[row.id].strip()
        assert row.x == ("\n\n" + values[row.id].strip())[:2000]


HEADERS = st.one_of(st.none(), st.text(alphabet="ab <>@\t\né", max_size=6))


@SLOW
@given(values=st.lists(st.tuples(HEADERS, HEADERS, HEADERS, HEADERS), min_size=1, max_size=40))
def test_external_id_equals_python(spark, values):
    import hashlib

    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id int, m string, f string, d string, s string")
    for row in df.select("id", external_id(*[F.col(c) for c in "mfds"]).alias("e")).collect():
        mid, *parts = [v or "" for v in values[row.id]]
        assert row.e == (mid.strip() or hashlib.sha1("".join(parts).encode()).hexdigest())


@SLOW
@given(
    values=st.lists(st.text(alphabet="abKkIéÉ%_\\\n.İK", max_size=8), min_size=1, max_size=40),
    query=st.text(alphabet="abKkéÉ%_\\\n.", max_size=4),
)
def test_like_equals_sqlite(spark, values, query):
    con = sqlite3.connect(":memory:")
    rows = column(spark, values).select("id", X.like_anywhere(F.col("body"), query).alias("hit")).collect()
    for row in rows:
        want = con.execute("SELECT ? LIKE ?", (values[row.id], f"%{query}%")).fetchone()[0]
        assert row.hit == bool(want), (values[row.id], query)


def test_html_to_text(spark):
    pages = [
        "<html><body><p>One &amp; <b>two</b></p><p>three</p></body></html>",
        "a<!-- <p>no</p> -->b<script>var x='</p>';</script>c<STYLE>p{}</STYLE >d",
        "<p>&copy; &#233; &lt;kept&gt;</p>",
        "no markup",
        "",
    ]
    rows = column(spark, pages).select("id", X.html_to_text(F.col("body")).alias("t")).orderBy("id").collect()
    assert [row.t for row in rows] == ["One & \ntwo\nthree", "a\nb\nc\nd", "© é <kept>", "no markup", ""]
    assert [X.html_text(page) for page in pages] == [row.t for row in rows]
    assert html.unescape("&amp;lt;") == "&lt;"


def test_decode_bytes(spark):
    df = spark.createDataFrame([(bytearray("é😀".encode()),), (bytearray(b"caf\xe9"),), (bytearray(b""),)], "b binary")
    assert [r.t for r in df.select(X.decode_bytes(F.col("b")).alias("t")).collect()] == ["é😀", "café", ""]


def test_dates(spark):
    mail = {
        "Mon, 1 Jan 2024 10:00:00 +0200 (EET)": "2024-01-01T08:00:00Z",
        "1 Jan 2024 10:00:00 GMT": "2024-01-01T10:00:00Z",
        "1 Jan 2024 10:00": "2024-01-01T10:00:00Z",
        "soon": None,
    }
    other = {
        "2024-01-01T10:00:00Z": "2024-01-01T10:00:00Z",
        "2024-01-01 10:00:00.25+01:30": "2024-01-01T08:30:00Z",
        "2024-01-01T10:00:00-0500": "2024-01-01T15:00:00Z",
        "2024-01-01T10:30Z": "2024-01-01T10:30:00Z",
        "2024-01-01": "2024-01-01T00:00:00Z",
        "2024-13-41T00:00:00Z": None,
    }
    calendar = {"20240101T100000Z": "2024-01-01T10:00:00Z", "20240101T100000": "2024-01-01T10:00:00Z",
                "20240101": "2024-01-01T00:00:00Z", "20241341": None, "": None}
    for function, cases in ((times.mail_date, mail), (times.any_date, mail | other), (times.calendar_date, calendar)):
        rows = column(spark, list(cases)).select("body", times.iso_text(function(F.col("body"))).alias("t")).collect()
        assert {row.body: row.t for row in rows} == cases


def test_markup_is_linear_and_unclosed_markup_runs_to_the_end(spark):
    import time

    cases = ["a <b>c", "a < b > c", "x<!-- y", "x<script>y", "x<script>y</script>z", "x<p", "1 <2", "t<style>s</style >u"]
    want = ["a \nc", "a < b > c", "x", "x", "x\nz", "x", "1 <2", "t\nu"]
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.x for r in frame.select("i", X.html_to_text(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == want == [X.html_text(case) for case in cases]
    for piece in ("<!--", "<", "<script>", "<a "):
        text = piece * (5_000_000 // len(piece))
        start = time.perf_counter()
        X.html_text(text)
        assert time.perf_counter() - start < 2
    long = spark.range(1).select(F.repeat(F.lit("<!--"), 1_250_000).alias("t"))
    start = time.perf_counter()
    long.select(F.length(X.html_to_text(F.col("t")))).collect()
    assert time.perf_counter() - start < 4


def test_records_are_cut_in_linear_time():
    import time

    from mailtables.sources.cutting import cut_records

    for size in (1, 3, 7, 100):
        data = b"before\nFrom a\nFrom b\n\nFrom c"
        cut = [data[i:i + size] for i in range(0, len(data), size)]
        assert list(cut_records(iter(cut), b"\nFrom ")) == [b"before\n", b"From a\n", b"From b\n\n", b"From c"]
        assert list(cut_records(iter(cut), b"\nFrom ", 7, first=False)) == [b"From a\n"]
        assert list(cut_records(iter(cut), b"\nFrom ", 6, first=False)) == []
    start = time.perf_counter()
    total = sum(len(r) for r in cut_records((b"x" * (1 << 20) for _ in range(256)), b"\nFrom "))
    assert total == 256 << 20 and time.perf_counter() - start < 4
