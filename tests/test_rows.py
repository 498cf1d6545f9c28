"""Dedupe, parts, vectors and search against plain Python."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from mailtables.operators import dedupe, parts, vectors
from mailtables.plans import search


def skewed(count, seed=1):
    """Rows of which a third share one key."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(200)}", i, f"v{i}") for i in range(count)]


def test_keep_one_first_and_last(spark):
    rows = skewed(3000)
    df = spark.createDataFrame(rows, "k string, n bigint, v string").repartition(7)
    first, last = {}, {}
    for key, n, value in rows:
        first.setdefault(key, (n, value))
        last[key] = (n, value)
    for keep, want in (("first", first), ("last", last)):
        for check in (False, True):
            got = dedupe.keep_one(df, "k", ["n"], keep, check_size=check).collect()
            assert {r.k: (r.n, r.v) for r in got} == want and len(got) == len(want)


def test_not_stored_and_upsert(spark):
    stored = spark.createDataFrame([("a", 0, "old"), ("b", 0, "old")], "k string, n bigint, v string")
    batch = spark.createDataFrame([("b", 1, "x"), ("b", 2, "new"), ("c", 1, "new")], "k string, n bigint, v string")
    for check in (False, True):
        assert {r.k for r in dedupe.not_stored(batch, stored, "k", check).collect()} == {"c"}
        got = {r.k: r.v for r in dedupe.upsert(stored, batch, "k", ["n"], check).collect()}
        assert got == {"a": "old", "b": "new", "c": "new"}


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(100).toDF("k")
    def hinted(d):
        return "Hint" in d._jdf.queryExecution().logical().toString()
    assert hinted(dedupe.broadcast_if_small(df, 100)) and not hinted(dedupe.broadcast_if_small(df, 99))


def test_bodies_from_parts(spark):
    rows = [
        ("whole", "2", " second \n"), ("whole", "1", "first"), ("whole", "3", " \t"), ("whole", "4", ""), ("whole", "5", "é"),
        ("cut", "a", "12345"), ("cut", "b", "67890"), ("cut", "c", "never read"),
        ("blank counts", "a", " " * 12), ("blank counts", "b", "not reached"),
        ("one long", "a", "x" * 50), ("empty", "a", " "),
    ]
    df = spark.createDataFrame(rows, "dir string, name string, text string").repartition(5)
    got = {r.dir: r.body for r in parts.bodies_from_parts(df).collect()}
    assert got == {
        "whole": "first\n\nsecond\n\né", "cut": "12345\n\n67890\n\nnever read", "blank counts": "not reached",
        "one long": "x" * 50,
    }
    got = {r.dir: r.body for r in parts.bodies_from_parts(df, 10).collect()}
    assert got == {"whole": "first\n\nsec", "cut": "12345\n\n678", "one long": "x" * 10}


def test_bodies_of_a_hot_folder(spark):
    rows = [("hot", f"{number:05}", f"part {number}") for number in range(3000)] + [("other", "1", "alone")]
    df = spark.createDataFrame(rows, "dir string, name string, text string").repartition(9)
    whole = {r.dir: r.body for r in parts.bodies_from_parts(df).collect()}
    assert whole["hot"].split("\n\n") == [f"part {number}" for number in range(3000)]
    cut = {r.dir: r.body for r in parts.bodies_from_parts(df, 300).collect()}
    assert cut == {"hot": whole["hot"][:300], "other": "alone"}


def test_first_names_uses_a_partial_limit(spark):
    df = spark.createDataFrame([("hot", f"{i:05}") for i in range(500)], "g string, name string").repartition(4)
    top = parts.first_names(df, "g", "name", 10)
    assert [r.name for r in top.orderBy("name").collect()] == [f"{i:05}" for i in range(10)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_top_k_equals_numpy(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(400, 16)).astype("float32")
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "message_id bigint, embedding array<float>")
    query = matrix[7].astype("float64")
    scores = matrix.astype("float64") @ query
    want = np.lexsort((np.arange(400), -scores))[:10]
    got = vectors.top_k(df, "message_id", query.tolist()).collect()
    assert [r.message_id for r in got] == want.tolist()
    assert np.allclose([r.score for r in got], scores[want])


def test_encoder_runs_once_per_task_and_gives_unit_vectors(spark):
    df = spark.createDataFrame([("Alpha beta beta",), ("",), (None,)], "t string")
    encode = vectors.encode_column(lambda: vectors.hashing_encoder(32))
    rows = [np.array(r.e) for r in df.select(encode("t").alias("e")).collect()]
    assert abs(np.linalg.norm(rows[0]) - 1) < 1e-6 and sorted(set(rows[0].round(3)))[-1] > 0.8
    assert not rows[1].any() and not rows[2].any()


def messages(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [
        (1, at, "a@x", "Invoice for Acme", "body", "Acme"),
        (2, at + dt.timedelta(days=1), "b@x", None, "an INVOICE for contoso", "Acme"),
        (3, None, None, "nothing", None, "Acme"),
        (4, at + dt.timedelta(days=2), "c@x", "invoice", "x" * 100, "Other"),
        (5, at + dt.timedelta(days=1), "d@x", "y" * 100, "invoice acme", None),
    ]
    return spark.createDataFrame(
        rows, "message_id bigint, sent_at timestamp, sender_email string, subject string, body string, account_tag string"
    )


def ids(df):
    return [r.message_id for r in df.collect()]


def test_searches(spark):
    df = messages(spark)
    assert ids(search.keyword_search(df, "invoice")) == [4, 2, 5, 1]
    assert ids(search.keyword_search(df, "invoice", 2)) == [4, 2]
    assert ids(search.keyword_search(df, "invoice", None)) == [4, 2, 5, 1] and ids(search.dossier(df, "Acme", None)) == [2, 1, 3]
    wanted = search.matches_terms(all_of=["invoice"], any_of=["acme", "contoso"])
    assert ids(search.keyword_search(df, wanted)) == [2, 5, 1]
    assert ids(search.keyword_search(df, search.matches_terms(none_of=["invoice"]))) == [3]
    assert ids(search.dossier(df, "Acme")) == [2, 1, 3]
    assert ids(search.timeline(df, "Acme")) == [3, 1, 2]
    report = search.search_report(search.keyword_search(df, "nothing")).first()
    assert report.asDict() == {"id": "3", "sent_at": "", "sender_email": "", "account_tag": "Acme", "subject": "nothing"}
    assert len(search.search_report(search.keyword_search(df, "yyy")).first().subject) == 80


def test_semantic_search_keeps_order_and_drops_missing(spark):
    vectors_df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (9, [0.99, 0.1]), (4, [0.0, 1.0])], "message_id bigint, embedding array<float>"
    )
    found = search.semantic_search(messages(spark), vectors_df, [1.0, 0.0], k=3)
    assert [(r.message_id, r.shown_score) for r in found.collect()] == [(1, "1.000"), (2, "0.600")]
    every = search.semantic_search(messages(spark), vectors_df, [1.0, 0.0], k=None)
    assert [r.message_id for r in every.collect()] == [1, 2, 4]


def test_dossier_report_does_not_read_bodies(spark, tmp_path):
    messages(spark).write.parquet(str(tmp_path / "m"))
    plan = search.dossier(spark.read.parquet(str(tmp_path / "m")), "Acme", report=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "EqualTo(account_tag,Acme)" in text
    assert "body" not in text.split("ReadSchema")[1]


def test_timeline_sort_is_distributed(spark):
    text = search.timeline(messages(spark), "Acme")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in text


def test_take_until_cuts_hot_groups_in_one_shuffle(spark):
    from mailtables.operators.parts import take_until

    rows = [("hot", f"n{i:05d}", i % 7) for i in range(3000)] + [("cold", "a", 5), ("cold", "b", None), (None, "x", 3),
                                                                  (None, "y", 3), ("cold", "c", 0), ("cold", "d", 9)]
    frame = spark.createDataFrame(rows, "dir string, name string, chars int").repartition(9)
    got = sorted((r["dir"] or "", r["name"]) for r in take_until(frame, "dir", "name", "chars", 20).collect())
    want = []
    for group in ("hot", "cold", None):
        before = 0
        for _, name, chars in sorted(r for r in rows if r[0] == group):
            if before < 20 and (chars or 0) > 0:
                want.append((group or "", name))
            before += chars or 0
    assert got == sorted(want)
    plan = take_until(frame, "dir", "name", "chars", 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(dir") == 1
