"""The substring index: a search through it gives the rows of the plain scan, and reads fewer bodies."""

import random

import pytest

from mailtables.operators import trigram_index as T
from mailtables.plans import search

SCHEMA = "message_id bigint, subject string, body string, sent_at timestamp, sender_email string, account_tag string"


def messages(spark, rows):
    return spark.createDataFrame([(i, s, b, None, None, None) for i, s, b in rows], SCHEMA)


def test_grams_of_queries():
    assert T.grams_of("HeHely") == ["ehe", "ely", "heh", "hel"]
    assert T.grams_of("the%on_nst") == ["nst", "the"]
    assert T.grams_of("ab%c_d") == [] and T.grams_of("") == []
    assert T.grams_of("ÉtÉ") == ["ÉtÉ"]  # only ASCII letters fold, as in the search


@pytest.mark.parametrize("wanted", [
    (["HeHely"], [], []), (["the%on_nst"], [], []), (["the"], ["thatin", "hehely"], ["ononst"]), (["ab"], [], []),
    ([], [], ["hehely"]), (["été"], [], []), (["x_y"], ["q%"], []),
])
def test_same_rows_as_the_scan(spark, tmp_path, wanted):
    rng = random.Random(3)
    words = ["HeHely", "hehely", "the", "THE", "ononst", "thatin", "été", "ÉTÉ", "xzy", "x y", "abc", "q", ""]
    rows = [(rng.choice([i, i, i, None, 7]), rng.choice([None, "ab", "The subject"]),
             None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
            for i in range(300)]
    rows.append((1000, "x", "hehe" + "z" * 50_000 + "ly hehely"))
    frame = messages(spark, rows)
    folder = str(tmp_path / "index")
    T.write_batch(frame.filter("message_id < 150 OR message_id IS NULL"), folder)
    T.write_batch(frame.filter("message_id >= 150"), folder)  # a second stored batch
    index = spark.read.parquet(folder)
    all_of, any_of, none_of = wanted
    condition = search.matches_terms(all_of, any_of, none_of)
    plain = sorted((tuple(r) for r in search.keyword_search(frame, condition, None).collect()), key=repr)
    narrowed = T.narrowed(frame, T.candidates(index, all_of, any_of))
    assert sorted((tuple(r) for r in search.keyword_search(narrowed, condition, None).collect()), key=repr) == plain
    if T.grams_of((all_of or ["ab"])[0]):
        assert narrowed.count() < frame.count()


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "index")
    frame = messages(spark, [])
    T.write_batch(frame, folder)
    index = spark.read.schema("id bigint, gram bigint").parquet(folder)
    assert T.narrowed(frame, T.candidates(index, ["hehely"])).count() == 0
