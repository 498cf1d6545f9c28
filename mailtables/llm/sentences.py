"""Substring dedup by sliding spans of sentences: later copies of repeated spans lose their sentences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtables.llm.lines import covered, text_classes, with_text_keys
from mailtables.llm.stored import saved
from mailtables.llm.words import lists, mixed, numbered, pieces

SPAN_SENTENCES = 3
SPAN_WORDS = 12
#: A sentence ends after marks and white space, or at a line end; the white space that follows belongs to it.
_END = re.compile(r"[.!?]+[ \t\r\n\f]+|\n[ \t\r\n\f]*")

_SPAN_DDL = "place bigint, t1 bigint, t2 bigint, starts array<bigint>, h1 array<bigint>, h2 array<bigint>"


def sentences(text: str) -> list[str]:
    """A text in sentences; together they are the text."""
    out, start = [], 0
    for end in _END.finditer(text):
        out.append(text[start:end.end()])
        start = end.end()
    if start < len(text):
        out.append(text[start:])
    return out


def spans(units: list[str], length: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and two 64-bit numbers of every run of `length` sentences with `least_words` words or more.

    Sentences are compared by their words, whatever the white space.
    """
    count = len(units) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = [unit.split() for unit in units]
    sizes = np.array([len(w) for w in words])
    digests = b"".join(hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest() for w in words)
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    factors = numbered(length, 5)
    totals, numbers = np.zeros(count, np.int64), np.zeros((count, 2), np.uint64)
    for step in range(length):
        totals += sizes[step:step + count]
        numbers += mixed(halves[step:step + count] + factors[step]) * factors[step]
    kept = np.flatnonzero(totals >= least_words)
    numbers = mixed(numbers[kept])
    return kept, numbers[:, 0], numbers[:, 1]


def _span_rows(batches: Iterator[pa.RecordBatch], length: int, least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 0):
            found = [spans(sentences(text), length, least_words) for text in part.column(0).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
            flat = [np.concatenate([f[i] for f in found]) for i in range(3)]
            arrays = [lists(c.view(np.int64), ends) for c in flat]
            yield pa.RecordBatch.from_arrays([*part.columns[1:4], *arrays], ["place", "t1", "t2", "starts", "h1", "h2"])


def dedup_sentences(
    docs: DataFrame, span_sentences: int = SPAN_SENTENCES, span_words: int = SPAN_WORDS, texts: bool = True
) -> DataFrame:
    """Each document without the sentences that a span with an earlier copy covers.

    doc_id, n_sentences, n_removed, n_spans (maximal removed runs), kept_sha256 and, with `texts`, kept. A span is
    every run of `span_sentences` sentences of one document, `span_words` words or more; its first place, by doc_id
    (none comes last), then position, keeps its sentences, unless another span covers them. Sentences are compared by
    their words. Null and empty texts have no sentences; texts of fewer sentences stay whole. Rows of one doc_id and
    text have one result. Columns other than doc_id and text are not read. Spans are told apart by 128 bits.

    Equal texts are one class: its first document goes on, the others lose every span. Span numbers are counted
    globally, partly before the shuffle; only those met twice are joined back.
    """
    keyed = with_text_keys(docs)
    rows = keyed.select("text", "place", "t1", "t2")
    rows = rows.mapInArrow(lambda b: _span_rows(b, span_sentences, span_words), _SPAN_DDL)
    classes = text_classes(rows, "starts", "h1", "h2")
    each = classes.select("node", "place", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("span"))
    each = each.select("node", "place", F.col("span.starts").alias("pos"), F.col("span.h1").alias("h1"), F.col("span.h2").alias("h2"))
    here = F.struct("place", "node", "pos")
    firsts = each.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(here).alias("first")).filter("times > 1")
    firsts = saved(firsts.drop("times"), "first-spans")
    later = each.join(firsts, ["h1", "h2"]).filter(here > F.col("first")).groupBy("node").agg(F.collect_set("pos").alias("later"))
    found = classes.join(later, "node", "left").filter("copies > 1 OR later IS NOT NULL")
    every = F.when(F.col("copies") > 1, F.col("starts"))
    found = saved(
        found.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("place").alias("first"), "later", every.alias("every")),
        "later-spans",
    )
    same = (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    joined = keyed.join(found.hint("merge"), same, "left")
    gone = F.when(F.col("place") > F.col("first"), F.col("every")).otherwise(F.col("later"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                units = sentences(text)
                marks = covered(starts, len(units), span_sentences, False)
                kept = "".join(unit for unit, out_ in zip(units, marks) if not out_)
                runs = sum(now and not before for now, before in zip(marks, [False, *marks]))
                out.append((len(units), sum(marks), runs, hashlib.sha256(kept.encode()).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:5 if texts else 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns],
                ["doc_id", "n_sentences", "n_removed", "n_spans", "kept_sha256", "kept"][:len(columns) + 1],
            )

    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, n_sentences bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.select("doc_id", "text", gone.alias("starts")).mapInArrow(cut, ddl + (", kept string" if texts else ""))
