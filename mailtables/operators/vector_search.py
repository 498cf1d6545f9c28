"""Many vector queries at once: exact top-k by inner product, in blocked matrix products.

Queries are numbered in a range sort and cut into blocks of at most `QUERY_BLOCK` rows, so a block never grows,
however the keys fall. Blocks are dealt into groups of at most `GROUP_BYTES` of vectors; each group is sent to every
task and the candidates are scanned once per group, in their own partitions (no shuffle of candidates). A task keeps,
per query, the best k seen so far (score, then smaller key) and hands them on when its partition ends: the first
level of the merge. The second level ranks, per query, the k of each task. Memory per task is the group plus k rows
per query of it; the driver holds one group of query vectors at a time, never the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailtables.session import scratch_dir

#: Queries of one block (one matrix product), and bytes of query vectors sent to every task at once.
QUERY_BLOCK = 1024
GROUP_BYTES = 64 << 20


def _usable(batch: pa.RecordBatch, dimensions: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose vector is whole (not null, no null, the given length, finite), and their vectors as float64."""
    column = batch.column(1)
    whole = pc.and_kleene(pc.is_valid(column), pc.equal(pc.list_value_length(column), dimensions))
    batch = batch.filter(pc.fill_null(whole, False))
    flat = batch.column(1).flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dimensions)
    ok = np.isfinite(matrix).all(axis=1)
    if flat.null_count:
        ok &= ~np.asarray(flat.is_null()).reshape(matrix.shape).any(axis=1)
    if not ok.all():
        batch, matrix = batch.filter(pa.array(ok)), matrix[ok]
    return batch, matrix


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query's scores: higher score first, then smaller key; all ties are weighed."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    order = np.lexsort((keys[near], -scores[near]))
    return near[order[:k]]


def _scan(group: list[tuple[np.ndarray, np.ndarray]], k: int, dimensions: int):
    """The task's scan: for every query of the group, the best k candidates of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [([np.empty(0)] * len(q), [np.empty(0, dtype="int64")] * len(q)) for q, _ in group]
        for batch in batches:
            batch, matrix = _usable(batch, dimensions)
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype("int64")
            for (queries, _), (best_scores, best_keys) in zip(group, kept):
                products = queries @ matrix.T
                for row in range(len(queries)):
                    scores = np.concatenate([best_scores[row], products[row]])
                    ids = np.concatenate([best_keys[row], keys])
                    chosen = _best(scores, ids, k)
                    best_scores[row], best_keys[row] = scores[chosen], ids[chosen]
        query_ids, keys, scores = [], [], []
        for (_, qkeys), (best_scores, best_keys) in zip(group, kept):
            for row, qkey in enumerate(qkeys):
                query_ids.append(np.full(len(best_keys[row]), qkey, dtype="int64"))
                keys.append(best_keys[row])
                scores.append(best_scores[row])
        if query_ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(query_ids)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(scores))],
                ["query_id", "key", "score"],
            )

    return run


def top_k_many(queries: DataFrame, candidates: DataFrame, k: int, label: str = "vector-queries") -> DataFrame:
    """query_id, rank (from 1), key, score: for each query (key, vector), its k best candidates (key, vector).

    Keys are longs. A vector that is null, holds a null or a non-finite value, or differs in length from the first
    whole query of smallest key takes no part, as query or candidate. Ties go to the smaller key; a query with fewer
    candidates gets all of them. A query key that repeats is answered once, with the least of its vectors; a repeated
    candidate row counts as often as it comes; null keys take no part. Empty queries or candidates: no rows.
    """
    spark = queries.sparkSession
    distinct = queries.groupBy(F.col(queries.columns[0]).alias("query_id")).agg(
        F.min(queries.columns[1]).alias("vector")
    ).filter(F.col("query_id").isNotNull())
    whole = distinct.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)
                                                                     & (F.abs(x) < F.lit(float("inf")))))
    folder = scratch_dir(spark, label)
    whole.repartitionByRange("query_id").sortWithinPartitions("query_id").withColumn(
        "place", F.monotonically_increasing_id()
    ).write.parquet(folder)
    placed = spark.read.parquet(folder).withColumns({
        "block": F.struct(F.shiftright("place", 33).alias("part"),
                          F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / QUERY_BLOCK).alias("cut")),
    })
    first = placed.agg(F.min_by(F.size("vector"), "query_id").alias("n")).first()
    if first["n"] is None:
        return spark.createDataFrame([], "query_id long, rank int, key long, score double")
    dimensions = int(first["n"])
    placed = placed.filter(F.size("vector") == dimensions)
    blocks = placed.groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()
    groups, group, used = [], [], 0
    for row in blocks:
        size = row["n"] * (dimensions * 8 + 16)
        if group and used + size > GROUP_BYTES:
            groups.append(group)
            group, used = [], 0
        group.append(row["block"])
        used += size
    groups += [group] if group else []
    pairs = candidates.select(F.col(candidates.columns[0]).cast("bigint").alias("key"), candidates.columns[1])
    pairs = pairs.filter(F.col("key").isNotNull())
    partial = None
    for group in groups:
        low, high = group[0], group[-1]
        inside = (F.col("block") >= F.struct(F.lit(low["part"]).alias("part"), F.lit(low["cut"]).alias("cut"))) & (
            F.col("block") <= F.struct(F.lit(high["part"]).alias("part"), F.lit(high["cut"]).alias("cut"))
        )
        by_block: dict = {}
        for r in placed.filter(inside).select("block", "query_id", "vector").collect():  # GROUP_BYTES at most
            by_block.setdefault((r["block"]["part"], r["block"]["cut"]), []).append(r)
        product = [
            (np.asarray([r["vector"] for r in rows], dtype="float64"), np.asarray([r["query_id"] for r in rows], dtype="int64"))
            for _, rows in sorted(by_block.items())
        ]
        found = pairs.mapInArrow(_scan(product, k, dimensions), "query_id long, key long, score double")
        partial = found if partial is None else partial.unionByName(found)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return partial.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "key", "score"
    )
