"""A substring index: the trigrams of each message's fields, written as posting rows sorted by trigram.

A `LIKE '%text%'` search needs every literal run of three or more characters of its text in the message, so a
message can only match if it holds all their trigrams. A search reads the postings of its trigrams only (each file is
sorted by trigram, so Parquet statistics skip the rest), keeps the ids that have them all, and verifies
just those messages with the exact condition. Postings are appended per stored batch; a search sees all batches.
Texts are folded as the search folds them (ASCII letters only), so the index never misses a match. A query whose
literal runs are all shorter than three characters, or a condition that only excludes, gives no trigram: then every
message is a candidate and the search is the plain scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtables.operators.dedupe import broadcast_if_small

GRAM = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_FOLD = str.maketrans(_UPPER, _LOWER)


def gram_keys(text: str) -> np.ndarray:
    """The distinct trigrams of a folded text as 63-bit numbers (three code points of 21 bits): exact, no hashing."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype("int64")
    if len(codes) < GRAM:
        return np.empty(0, dtype="int64")
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])


def _posting_batches(fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            columns = [batch.column(i + 1).to_pylist() for i in range(fields)]
            keys = batch.column(0)
            for row in range(batch.num_rows):
                found = [gram_keys(c[row].translate(_FOLD)) for c in columns if c[row]]
                every = np.unique(np.concatenate(found)) if found else np.empty(0, dtype="int64")
                ids.append(np.full(len(every), row))
                grams.append(every)
            if ids:
                places = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([keys.take(places), pa.array(np.concatenate(grams))], ["id", "gram"])

    return run


def postings(messages: DataFrame, key: str = "message_id", fields: Sequence[str] = ("subject", "body")) -> DataFrame:
    """id, gram: each distinct trigram (as a 63-bit number) of each message's fields, folded as the search folds
    them (a null field has none), whole texts. One vectorized pass per text; rows that repeat an id give their
    postings again, which a search counts once."""
    kind = dict(messages.dtypes)[key]
    rows = messages.select(F.col(key).alias("id"), *[F.col(f).cast("string") for f in fields])
    return rows.mapInArrow(_posting_batches(len(fields)), f"id {kind}, gram bigint")


def write_batch(messages: DataFrame, folder: str, key: str = "message_id",
                fields: Sequence[str] = ("subject", "body")) -> None:
    """Append the postings of one batch of messages to the index in `folder`. Each task writes its own messages'
    postings sorted by trigram, so Parquet's row-group statistics let a search skip what does not hold its trigrams;
    nothing is shuffled."""
    postings(messages, key, fields).sortWithinPartitions("gram", "id").write.mode("append").parquet(folder)


def segments(query: str) -> list[str]:
    """The literal runs of a LIKE text (`%` and `_` are wildcards), folded like the texts."""
    return [s.translate(str.maketrans(_UPPER, _LOWER)) for s in re.split(r"[%_]", query) if s]


def grams_of(query: str) -> list[str]:
    """The distinct trigrams that every message matching `query` holds; empty if it has no run of three."""
    return sorted({s[i:i + GRAM] for s in segments(query) for i in range(len(s) - GRAM + 1)})


def having_all(index: DataFrame, grams: list[str]) -> DataFrame | None:
    """Ids that hold every gram (None: no gram, every message is a candidate). Reads the grams' postings only."""
    if not grams:
        return None
    keys = sorted({int(k) for g in grams for k in gram_keys(g)})
    found = index.filter(F.col("gram").isin(keys)).groupBy("id").agg(F.count_distinct("gram").alias("n"))
    return found.filter(F.col("n") == len(keys)).select("id")


def candidates(index: DataFrame, all_of: Sequence[str] = (), any_of: Sequence[str] = ()) -> DataFrame | None:
    """Ids that may match every text of `all_of` and one of `any_of`; None if the trigrams rule nobody out."""
    sets = [s for s in (having_all(index, grams_of(t)) for t in all_of) if s is not None]
    if any_of:
        alternatives = [having_all(index, grams_of(t)) for t in any_of]
        if all(a is not None for a in alternatives):
            union = alternatives[0]
            for other in alternatives[1:]:
                union = union.unionByName(other)
            sets.append(union.distinct())
    if not sets:
        return None
    result = sets[0]
    for other in sets[1:]:
        other = other.withColumnRenamed("id", "other_id")
        result = result.join(other, F.col("id").eqNullSafe(F.col("other_id")), "left_semi")
    return result


def narrowed(messages: DataFrame, ids: DataFrame | None, key: str = "message_id") -> DataFrame:
    """The messages whose key is among `ids` (null keys too, when a null-keyed message is a candidate); all if None.

    The ids are broadcast when counted within the bounds, else both sides are shuffled.
    """
    if ids is None:
        return messages
    return messages.join(broadcast_if_small(ids), messages[key].eqNullSafe(F.col("id")), "left_semi")
