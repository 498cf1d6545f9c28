"""Point lookups by id bucket: the rows of a plain filter, from a few bucket folders only."""

import os

from pyspark.sql import functions as F

from mailtables.operators import id_buckets as B


def test_lookups(spark, tmp_path):
    rows = [(i % 700 if i % 50 else None, f"text {i}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "message_id bigint, body string")
    folder = str(tmp_path / "store")
    B.write_bucketed(frame.filter("message_id < 300 OR message_id IS NULL"), folder, "message_id")
    B.write_bucketed(frame.filter("message_id >= 300"), folder, "message_id")  # a second batch
    stored = sorted(os.listdir(folder))
    assert len([d for d in stored if d.startswith("id_bucket=")]) <= B.BUCKETS + 1
    ids = [3, 77, 140, 211, 299, 301, 450, 512, 699, 9999]
    got = sorted(tuple(r) for r in B.lookup(spark, folder, "message_id", ids + [None]).collect())
    assert got == sorted(tuple(r) for r in frame.filter(F.col("message_id").isin(ids)).collect())
    assert len(B.buckets_of(spark, ids)) <= len(ids)
    batch = spark.createDataFrame([(5,), (5,), (None,), (123456,), (640,)], "message_id bigint")
    got = sorted(tuple(r) for r in B.matching(spark, folder, "message_id", batch).collect())
    assert got == sorted(tuple(r) for r in frame.filter(F.col("message_id").isin([5, 640])).collect())
    assert B.matching(spark, folder, "message_id", batch.filter(F.lit(False))).count() == 0
    assert B.lookup(spark, folder, "message_id", []).count() == 0
