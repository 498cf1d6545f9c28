import zlib

import corpus_pipeline
from odd import ODD
from mailtables.llm import toxicity
from pyspark.sql import functions as F


def labelled(spark, docs, count=600):
    rows, labels = [], []
    for i in range(count):
        toxic = i % 7 == 0
        text = f"the weather of day {i} was fine and calm as on day {i * 3}. " * 3
        rows.append((i, text + ("you are a stupid idiot, you moron!" if toxic else "thank you all."), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, docs):
    frame, labels = labelled(spark, docs)
    out = toxicity.scored(frame, labels)
    assert [c for c in out.columns if c not in frame.columns] == ["held_out", "predicted"]  # score was there
    rows = out.collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held) >= 0.98 * len(held)
    kept = toxicity.reject(frame, labels)
    assert kept.columns == frame.columns


def test_odd_rows_and_labels(spark, docs):
    frame, labels = labelled(spark, docs, 200)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (4, 0, 5), (5, None, 1), (5, 0, 0)], labels.schema))
    model = toxicity.fit(frame, odd)
    rows = model.score(docs(ODD)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert model.score(docs([])).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.scored(docs(ODD), none).collect()} == {0.0}
    one_kind = labels.filter("toxic = 0")
    assert {r["predicted"] for r in toxicity.scored(frame, one_kind).collect()} == {0}
    assert toxicity.scored(docs([]), labels).count() == 0


def test_learned_words_and_masks():
    lexicon = toxicity.Lexicon({"blorb": 2.0}, {"zork": 3.0})
    names = dict(zip(toxicity.FEATURES, toxicity.features("You zorkian blorb, id!ot and i.d.i.o.t SHOUT stuuupid", lexicon, [0, 1, 2, 3, 4, 5], 50)))
    assert names["learned_words"] > 0 and names["learned_beginnings"] > 0 and names["shouted"] > 0
    assert names["masked"] > 0 and names["masked_insults"] > 0 and names["stretched"] > 0
    near = dict(zip(toxicity.FEATURES, toxicity.features("you are an idiot " + "word " * 20 + "idiot", lexicon, [0] * 6, 50)))
    assert near["second_person_near"] * 25 == 1 and near["insult_count"] > 0
    long = toxicity.features("calm words " * 300_000, lexicon, [0] * 6, 3_300_000)
    assert round(2.718281828 ** long[0]) - 1 == 600_000


def test_stages_are_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == first.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and ids
        docs = corpus_pipeline.saved(out, f"test-{name}")
    assert docs.columns == [*first.columns, "shard", "slot"]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.select("doc_id", "shard", "slot").collect())) == sorted(
        map(tuple, docs.select("doc_id", "shard", "slot").collect())
    )


def test_every_stage_takes_odd_rows(spark, docs, sf):
    frame = docs(ODD).drop("size", "shard", "score", "_features").withColumn("n_chars", F.lit(1).cast("bigint"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, sf).count() > 0, name
        assert stage(spark, frame.limit(0), sf).count() == 0, name
