import math

import numpy as np
import pytest

from mailtables.llm import topk
from pyspark.sql import functions as F


def brute(rows, k, factor=64):
    ok = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: a for i, a in sorted(ok, key=lambda r: (r[0], r[1]), reverse=True)}.items():
        if q % 20:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def run(spark, rows, k):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    vectors = frame.filter(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding"), 64).alias("ints"))
    return {tuple(r) for r in topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, k).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    numbers = np.random.default_rng(5)
    rows = [(i, [float(x) for x in numbers.normal(size=6) / 3]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    assert run(spark, rows, 20) == brute(rows, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -2.0]), (20, None), (40, [None, 1.0]), (60, [nan, 1.0]), (80, [inf, 0.0]), (100, []), (None, [1.0, 1.0]),
        (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0, 2.0, 3.0]), (120, [1e6, -1e6]), (4, [0.0, 0.0]),
    ]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, [], 3) == set()


@pytest.mark.parametrize("scale", [1, 10**4, 10**6])
def test_bounds_hold_in_a_block(scale):
    numbers = np.random.default_rng(1)
    rows = (numbers.normal(size=(300, 8)) * scale * 30).astype(np.int64)
    rows[::7] = rows[0]
    lists = topk.SortedLists(np.arange(300), rows)
    got = {}
    for frame in lists.best(np.arange(0, 300, 20), rows[::20], 10):
        for q, i, s in frame.itertuples(index=False):
            got.setdefault(q, []).append((-s, i))
    for q in range(0, 300, 20):
        want = sorted((-int(rows[q] @ rows[i]), i) for i in range(300) if i != q)[:10]
        assert sorted(got[q]) == want
    upper, lower = lists._bounds(rows[:5].astype(np.float64), 100)
    exact = rows[:5] @ rows.T
    assert (upper >= exact).all() and (lower <= exact).all()
