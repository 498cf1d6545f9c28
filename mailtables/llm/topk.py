"""Exact top-k search by inner product: sorted lists read in step, with score bounds and no random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailtables.llm.stored import saved

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
_QUERIES_AT_ONCE = 256
#: How far, as a share of the list, all lists have been read when the bounds are looked at.
_DEPTHS = (0.5, 0.875, 1.0)


def scaled(vector: Column, factor: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and no component null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The `k` best candidates of each query: query_id, rank (from 1), vec_id, score.

    Both tables have vec_id and `ints` (whole-number components). Score: inner product, exact while it fits 64 bits.
    Ties go to the smaller vec_id. A query never meets candidates of its own vec_id, and only candidates with as many
    components. A vec_id that repeats among the queries is one query (its smallest vector); candidates that repeat
    are candidates of their own. Rows without vec_id take no part; an empty table gives an empty result.

    Candidates are dealt into blocks of about `CANDIDATE_BLOCK` rows and queries into blocks of about `QUERY_BLOCK`,
    by row numbers, whatever the vectors look like. Each pair of blocks meets in one task, which hands on `k` rows a
    query; a window over those takes the final `k`.
    """
    queries = queries.filter("vec_id IS NOT NULL").groupBy("vec_id", F.size("ints").alias("dims")).agg(
        F.min("ints").alias("ints")
    )
    candidates = candidates.filter("vec_id IS NOT NULL").select("vec_id", F.size("ints").alias("dims"), "ints")
    queries = saved(queries.withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    candidates = saved(candidates.withColumn("row", F.monotonically_increasing_id()), "topk-candidates")
    asked, offered = -(-queries.count() // QUERY_BLOCK), -(-candidates.count() // CANDIDATE_BLOCK)

    def dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.lit(max(1, own_blocks))).alias(own)
        others = F.explode(F.expr(f"sequence(0L, {max(1, other_blocks) - 1}L)")).alias(other)
        return rows.select("dims", block, others, "vec_id", "ints")

    keys = ["dims", "asked", "offered"]
    left = dealt(queries, "asked", asked, "offered", offered).groupBy(*keys)
    right = dealt(candidates, "offered", offered, "asked", asked).groupBy(*keys)
    found = left.cogroup(right).applyInPandas(
        lambda q, c: _block_result(q, c, k), "query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _block_result(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    parts = []
    if len(queries) and len(candidates):
        lists = SortedLists(candidates["vec_id"].to_numpy(), np.stack(candidates["ints"].to_numpy()))
        ids, asked = queries["vec_id"].to_numpy(), np.stack(queries["ints"].to_numpy())
        for at in range(0, len(ids), _QUERIES_AT_ONCE):
            parts.extend(lists.best(ids[at:at + _QUERIES_AT_ONCE], asked[at:at + _QUERIES_AT_ONCE], k))
    columns = ["query_id", "vec_id", "score"]
    return pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})


class SortedLists:
    """One block of candidates as a list per component, sorted by value.

    A query reads the lists of its positive components from the top and those of its negative ones from the bottom,
    all to the same depth. What has not been read yet is bounded by the last value read and by the list's far end.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, order, 0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(ids))[:, None], 0)
        self.by_id = np.argsort(ids, kind="stable")

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
        """The k best of each query (more where scores tie, never fewer), as frames of query_id, vec_id, score."""
        n = len(self.ids)
        largest = int(np.abs(self.rows).max()) * int(np.abs(queries).max()) * self.rows.shape[1]
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        open_queries = np.arange(len(query_ids))
        for depth in [max(1, int(n * share)) for share in _DEPTHS]:
            upper, lower = self._bounds(queries[open_queries].astype(kind), depth)
            query, own = self._own(query_ids[open_queries])
            floor = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            upper[query, own] = lower[query, own] = floor
            if n > k:
                least = np.partition(lower, n - k, axis=1)[:, n - k]  # k candidates are sure to reach this
            else:
                least = np.full(len(open_queries), floor)
            alive = (upper >= least[:, None]) & (upper > floor)
            # a query is done when few candidates can still qualify, or all lists have been read
            done = (alive.sum(axis=1) <= 4 * k) | (depth == n)
            if done.any():
                at, candidate = np.nonzero(alive & done[:, None])
                query = open_queries[at]
                yield self._resolved(query_ids, queries, query, candidate, k)
            open_queries = open_queries[~done]
            if not len(open_queries):
                return

    def _bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The highest and the lowest score that each candidate can have for each query."""
        n, kind = len(self.ids), queries.dtype
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        from_top, from_bottom = self.place >= n - depth, self.place < depth

        def seen(read: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
            return np.where(read, self.rows, otherwise).astype(kind).T

        upper = up @ seen(from_top, self.sorted[n - depth]) + down @ seen(from_bottom, self.sorted[depth - 1])
        if depth == n:
            return upper, upper.copy()
        return upper, up @ seen(from_top, self.sorted[0]) + down @ seen(from_bottom, self.sorted[-1])

    def _own(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) of equal ids."""
        ordered = self.ids[self.by_id]
        first, last = np.searchsorted(ordered, query_ids, "left"), np.searchsorted(ordered, query_ids, "right")
        query = np.repeat(np.arange(len(query_ids)), last - first)
        step = np.arange(len(query)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        return query, self.by_id[first[query] + step]

    def _resolved(self, query_ids, queries, query, candidate, k) -> pd.DataFrame:
        """Final scores of the candidates that stayed, in pieces, and the k best of each query."""
        score = np.empty(len(query), np.int64)
        for at in range(0, len(query), 100_000):
            piece = slice(at, at + 100_000)
            score[piece] = np.einsum("ij,ij->i", queries[query[piece]], self.rows[candidate[piece]])
        order = np.lexsort((self.ids[candidate], -score, query))
        query, candidate, score = query[order], candidate[order], score[order]
        begins = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - begins < k
        return pd.DataFrame({
            "query_id": query_ids[query[keep]], "vec_id": self.ids[candidate[keep]], "score": score[keep],
        })
