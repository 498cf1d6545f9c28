"""Embeddings: the encoder hook, the stand-in encoder, and exact top-k by inner product."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Fixed value: how many hits a semantic search returns.
TOP_K = 10

_WORDS = re.compile(r"[a-z]+")


class _Places(dict):
    """Word -> place, remembered for the words met lately."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        place = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimensions
        self[word] = place
        return place


def hashing_encoder(dimensions: int = 256) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a sentence model: unit-length counts of hashed words. Lexical only, not semantic.

    A word's place is the first 8 hex digits of its MD5 modulo `dimensions`.
    """
    places = _Places(dimensions)

    def encode(texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), dimensions))
        for row, text in enumerate(texts):
            spots = [places[word] for word in _WORDS.findall(text.lower())]
            counts[row] = np.bincount(spots, minlength=dimensions) if spots else 0
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        return counts / np.where(norms == 0, 1, norms)

    return encode


def encode_column(make_encoder: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A pandas UDF `text -> array<float>`. `make_encoder` runs once per task, so a model is loaded once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            vectors = np.asarray(encoder(texts.fillna("").tolist()), dtype="float32")
            yield pd.Series(list(vectors))

    return encode


def top_k(vectors: DataFrame, key: str, query: list[float], k: int | None = TOP_K, vector: str = "embedding") -> DataFrame:
    """The `k` rows with the largest inner product, as (key, score); all rows, sorted, if `k` is None.

    Scores are one matrix product per Arrow batch, in double precision, and a batch hands on its own best `k`. Vectors
    that are null, hold nulls or have another length than the query have no score and drop out.
    """
    other = np.asarray(query, dtype="float64")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            whole = pc.and_kleene(pc.is_valid(column), pc.equal(pc.list_value_length(column), len(other)))
            batch = batch.filter(whole)
            flat = batch.column(1).flatten()
            matrix = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, len(other))
            if flat.null_count:
                full = ~np.asarray(flat.is_null()).reshape(matrix.shape).any(axis=1)
                batch, matrix = batch.filter(pa.array(full)), matrix[full]
            score = matrix @ other
            keys = batch.column(0)
            if k is not None and len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                kept = np.flatnonzero(~(score < least))
                keys, score = keys.take(pa.array(kept)), score[kept]
            yield pa.RecordBatch.from_arrays([keys, pa.array(score)], [key, "score"])

    kind = dict(vectors.dtypes)[key]
    rows = vectors.select(key, vector).mapInArrow(scored, f"`{key}` {kind}, score double")
    best = rows.orderBy(F.desc("score"), F.asc(key))
    return best if k is None else best.limit(k)
