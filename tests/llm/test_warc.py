import gzip
import hashlib
import io
import random

import pytest

from mailtables.llm import warc
from mailtables.session import scratch_dir
from pyspark.sql import functions as F


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("offset", F.lit("x"))


def test_round_trip(spark):
    big = "é" * 60 + "<p>"
    rows = [
        (5, "http://a.example.com/x?y=1", big), (3, "https://B.example.com/", big), (9, None, big), (9, None, big),
        (3, "https://B.example.com/", big), (1, "not a url\r\nX: y", None), (2, "", ""), (4, "http://a.example.com/x", "short"),
        (7, "http://a.example.com/x", "short"), (None, "http://n.example/", big), (9, "http://other.example/", "z" * 200),
        (11, "http://a/", "w" * 300_000),
    ]
    out = warc.archived(pages(spark, rows), payloads=True).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["record_type"] == ("revisit" if r["refers_to"] is not None else "response")
        if r["record_type"] == "response":
            assert r["intact"] and hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    kinds = sorted((r["page_id"] or 0, r["payload_bytes"], r["refers_to"]) for r in out if r["payload_bytes"] == len(big.encode()))
    n = len(big.encode())
    assert [k for k in kinds if k[2] is None] == [(0, n, None), (3, n, None), (3, n, None)]
    assert [k for k in kinds if k[2] is not None] == [(5, n, 3), (9, n, 3), (9, n, 3)]
    assert sorted(r["position"] for r in out) == list(range(len(rows)))
    assert warc.archived(pages(spark, [])).count() == 0


def test_histories_are_in_order(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i % 5}", f"text {i}") for i in range(500)]
    frame = pages(spark, rows).repartition(6)
    folder = scratch_dir(spark, "warc-test")
    index = warc.write_archives(frame, folder, archive_bytes=4000)
    assert index.select("file").distinct().count() > 6
    merged = warc.merge_runs(index).orderBy("position").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in merged]
    assert keys == sorted(keys) and len(keys) == 500
    assert keys[0][0] == "com,example,h0)/0"


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 8])
def test_loser_tree(count):
    numbers = random.Random(count)
    runs = [sorted(numbers.choices(range(20), k=numbers.randrange(0, 9))) for _ in range(count)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_members_across_reads(monkeypatch):
    monkeypatch.setattr(warc, "_READ", 7)
    parts = [b"a" * n for n in (0, 1, 100, 5000)]
    data = b"".join(warc.gzip_member(p) for p in parts)
    assert gzip.decompress(data) == b"".join(parts)
    found = list(warc.gzip_members(io.BytesIO(data)))
    assert [p for _, p in found] == parts
    assert [o for o, _ in found] == [sum(len(warc.gzip_member(p)) for p in parts[:i]) for i in range(4)]
    with pytest.raises(ValueError):
        list(warc.gzip_members(io.BytesIO(data[:-3])))
