"""Charset detection: texts in four charsets come back; what fits none falls back to Latin-1."""

import pytest
from pyspark.sql import functions as F

from mailtables.functions import charsets

SAMPLES = {
    "cp1251": "Привет, мир! Съешь же ещё этих мягких французских булок, да выпей чаю.",
    "shift_jis": "こんにちは、世界。今日はいい天気ですね。日本語の文章をここに書きます。",
    "gb18030": "我们在这里说中文，这是一个很好的例子。你好，世界！",
    "cp1252": "Déjà vu: l’été à Noël, ça coûte 5 € — naïve façade, Straße.",
}


@pytest.mark.parametrize("charset", sorted(SAMPLES))
def test_detect(charset):
    assert charsets.detect(SAMPLES[charset].encode(charset)) == (charset, SAMPLES[charset])


def test_column(spark):
    rows = [(i, SAMPLES[c].encode(c)) for i, c in enumerate(sorted(SAMPLES))]
    rows += [(10, b""), (11, None), (12, "plain ascii and é".encode()), (13, bytes(range(0x80, 0xA0)) * 3),
             (14, SAMPLES["cp1251"].encode("cp1251") * 2000)]
    frame = spark.createDataFrame(rows, "id int, content binary")
    got = {r["id"]: r["d"] for r in frame.select("id", charsets.decode_detected(F.col("content")).alias("d")).collect()}
    for i, c in enumerate(sorted(SAMPLES)):
        assert tuple(got[i]) == (c, SAMPLES[c])
    assert tuple(got[10]) == ("utf-8", "") and got[11] is None and tuple(got[12]) == ("utf-8", "plain ascii and é")
    assert got[13]["charset"] in charsets.CANDIDATES + (charsets.FALLBACK,)
    assert tuple(got[14]) == ("cp1251", SAMPLES["cp1251"] * 2000)
