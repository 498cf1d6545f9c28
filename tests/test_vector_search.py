"""Many vector queries at once against a brute force, over many blocks and groups, with ties and broken vectors."""

import math
import random

import pytest

from mailtables.operators import vector_search as V


def brute(rows, query_ids, k):
    whole = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 3
             and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if i in query_ids:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, qv in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in whole))
        out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, group", [(1024, 64 << 20), (3, 100)])
def test_against_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "GROUP_BYTES", group)
    rng = random.Random(11)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(300)]  # one very common vector: ties by the hundred
    rows += [(None, [1.0, 0.0, 0.0]), (2000, None), (2001, [1.0, None, 0.0]), (2002, [float("nan"), 0.0, 0.0]),
             (2003, [1.0, 2.0]), (2004, [float("inf"), 0.0, 0.0]), (5, [9.0, 9.0, 9.0]), (2050, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(7)
    queries = frame.filter("vec_id % 50 = 0")
    got = sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 9))
                 for r in V.top_k_many(queries, frame, 20).collect())
    assert got == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 20)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert V.top_k_many(frame, frame, 5).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    assert V.top_k_many(one, frame, 5).count() == 0
    assert [tuple(r) for r in V.top_k_many(one, one, 5).collect()] == [(1, 1, 1, 1.0)]
