"""The registered queries of this package: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtables.llm import (
    decontaminate, jaccard, lines, mixing, prefix_trie, sentences, sharding, spelling, suffixes, topk, toxicity, urls, warc,
)
from mailtables.session import configure, spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Arrow batches are bounded in bytes, as some rows here are whole index segments."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mixing(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", topk.scaled(F.col("embedding"), 64).alias("ints"))
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, 20)


def op3_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"), texts=False)


def op4_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scored(documents, labels).select("doc_id", "held_out", "score", "predicted")


def op5_sharding(spark, sf_dir):
    plan = sharding.plan_shards(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_jaccard(spark, sf_dir):
    return jaccard.link_groups(table(spark, sf_dir, "documents"), length=3, link=(90, 100))


def op7_sentence_spans(spark, sf_dir):
    return sentences.dedup_sentences(table(spark, sf_dir, "documents"), texts=False)


def op8_suffix_array(spark, sf_dir):
    return suffixes.dedup(table(spark, sf_dir, "documents"), texts=False)


def op9_decontamination(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found)


def op10_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_spelling(spark, sf_dir):
    groups = spelling.spelling_groups(table(spark, sf_dir, "documents"))
    return groups.select("word", "form", "root", "n", "n_near", "form_n")


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_url_filters(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "learned")


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_topk": op2_topk,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_jaccard": op6_jaccard,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_suffix_array": op8_suffix_array,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_url_filters": op13_url_filters,
}
