"""Benchmark decontamination with a positional inverted index, stored in segments of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtables.llm.stored import saved
from mailtables.llm.words import PLAIN, list_values, lists, pieces, words

WINDOW = 13
#: Test windows searched for in one pass over the index; more of them take more passes over the same index.
WINDOWS_A_PASS = 100_000
_SEGMENT_BYTES = 512 << 10
_AT_ONCE = 1 << 20  # starts looked at together
_TERM_SHIFT = np.int64(40)

_SEGMENT_DDL = (
    "segment bigint, doc_ids array<bigint>, n_words array<bigint>, terms array<bigint>, starts array<bigint>, "
    "docs array<int>, positions array<int>"
)
_FOUND_DDL = (
    "segment bigint, ordinal int, doc_id bigint, n_words bigint, spans array<bigint>, items array<string>, "
    "near_items array<string>"
)


@dataclass
class Windows:
    """Test windows of one pass: `terms` per window (short windows are filled up with -1) and the item of each."""

    terms: np.ndarray
    lengths: np.ndarray
    items: np.ndarray


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every run of `window` words of every item (an item of fewer words, but not none, is one run): item, terms.

    Items are named by their id as text; a null id is the empty text. Rows of one id are one item.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                numbers, bounds = words(part.column(1), PLAIN)
                numbers = numbers.view(np.int64)
                for row, item in enumerate(part.column(0).to_pylist()):
                    own = numbers[bounds[row]:bounds[row + 1]]
                    if len(own):
                        runs = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own)))
                        for at in range(0, len(runs), 10_000):
                            some = runs[at:at + 10_000]
                            ends = np.arange(len(some) + 1) * some.shape[1]
                            names = pa.array([item] * len(some), pa.string())
                            yield pa.RecordBatch.from_arrays([names, lists(some.ravel(), ends)], ["item", "terms"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return saved(named.mapInArrow(cut, "item string, terms array<bigint>").distinct(), "test-windows")


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The written index of `docs` (doc_id bigint, text): a row is a segment, a run of neighbouring documents.

    For each term of the sorted `vocabulary` that occurs, a segment has a posting list (`starts` cuts `docs` and
    `positions`): the document's place in the segment and the word's place in it, in order. Only test terms are kept,
    as no other term can take part in a match. Every document has its id and number of words in its segment.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        known = shared.value
        for batch in batches:
            for part in pieces(batch, 1, _SEGMENT_BYTES):
                yield _segment(number, part, known)
                number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return saved(rows.mapInArrow(segments, _SEGMENT_DDL), "posting-index", **{"parquet.block.size": 16 << 20})


def _segment(number: int, part: pa.RecordBatch, known: np.ndarray) -> pa.RecordBatch:
    numbers, bounds = words(part.column(1), PLAIN)
    numbers = numbers.view(np.int64)
    term = np.searchsorted(known, numbers)
    term[term == len(known)] = 0
    kept = np.flatnonzero(known[term] == numbers) if len(known) else np.zeros(0, np.int64)
    order = np.argsort(term[kept], kind="stable")
    kept = kept[order]
    found, starts = np.unique(term[kept], return_index=True)
    doc = np.searchsorted(bounds, kept, "right") - 1
    columns = [
        np.asarray(part.column(0).fill_null(0)), np.diff(bounds), known[found] if len(known) else kept,
        np.append(starts, len(kept)), doc.astype(np.int32), (kept - bounds[doc]).astype(np.int32),
    ]
    arrays = [lists(c if c.dtype == np.int32 else c.astype(np.int64), np.array([0, len(c)])) for c in columns]
    if part.column(0).null_count:
        arrays[0] = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
    names = ["segment", "doc_ids", "n_words", "terms", "starts", "docs", "positions"]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *arrays], names)


class Segment:
    """One index segment with the positions of all its documents on one line, far enough apart."""

    def __init__(self, n_words: np.ndarray, terms, starts, docs, positions, gap: int):
        self.base = np.concatenate([[0], np.cumsum(n_words + gap)])
        self.terms, self.starts = terms, starts
        self.places = self.base[docs] + positions
        # term and place in one number, in order: membership in any list is one binary search
        self.keys = (np.repeat(np.arange(len(terms)), np.diff(starts)) << _TERM_SHIFT) | self.places

    def has(self, term: np.ndarray, low: np.ndarray, width: int = 1) -> np.ndarray:
        """Whether a term's list has a place from `low` to `low + width - 1`."""
        asked = (term << _TERM_SHIFT) + np.maximum(low, 0)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return (self.keys[at] >= asked) & (self.keys[at] < (term << _TERM_SHIFT) + low + width)

    def lists_of(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows all of whose terms occur, their lists, and their columns from the rarest term on."""
        none = np.zeros((0, windows.terms.shape[1]), np.int64)
        if not len(self.terms):
            return np.zeros(0, np.int64), none, none
        at = np.minimum(np.searchsorted(self.terms, windows.terms), len(self.terms) - 1)
        filled = np.arange(windows.terms.shape[1]) < windows.lengths[:, None]
        held = (self.terms[at] == windows.terms) | ~filled
        alive = np.flatnonzero(held.all(axis=1))
        sizes = np.where(filled[alive], np.diff(self.starts)[at[alive]], np.iinfo(np.int64).max)
        return alive, at[alive], np.argsort(sizes, axis=1, kind="stable")

    def rarest_postings(self, lists_: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place) of every posting of each window's rarest term, in pieces."""
        first = lists_[np.arange(len(lists_)), order[:, 0]] if len(lists_) else np.zeros(0, np.int64)
        sizes = np.diff(self.starts)[first] if len(first) else first
        ends = np.cumsum(sizes)
        for low in range(0, int(ends[-1]) if len(ends) else 0, _AT_ONCE):
            number = np.arange(low, min(low + _AT_ONCE, int(ends[-1])))
            window = np.searchsorted(ends, number, "right")
            within = number - (ends[window] - sizes[window])
            yield window, self.places[self.starts[first[window]] + within]

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, first place) of every exact occurrence.

        Lists are moved back by the term's place in the window and intersected, from the rarest term on.
        """
        alive, lists_, order = self.lists_of(windows)
        found = []
        for window, place in self.rarest_postings(lists_, order):
            start = place - order[window, 0]
            for step in range(1, windows.terms.shape[1]):
                column = order[window, step]
                there = (column >= windows.lengths[alive[window]]) | self.has(lists_[window, column], start + column)
                window, start = window[there], start[there]
                if not len(window):
                    break
            found.append((alive[window], start))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, first place) where all its words lie, in any order, within `slop` places more than it has."""
        alive, lists_, order = self.lists_of(windows)
        found = []
        for window, place in self.rarest_postings(lists_, order):
            for back in range(windows.terms.shape[1] + slop):
                width = windows.lengths[alive[window]] + slop
                own, start = window[back < width], (place - back)[back < width]
                for step in range(1, windows.terms.shape[1]):
                    column = order[own, step]
                    span = windows.lengths[alive[own]] + slop
                    there = (column >= windows.lengths[alive[own]]) | self.has(lists_[own, column], start, span)
                    own, start = own[there], start[there]
                found.append((alive[own], start + back))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _search(batches: Iterator[pa.RecordBatch], windows: Windows, slop: int | None) -> Iterator[pa.RecordBatch]:
    width = windows.terms.shape[1]
    gap = width + (slop or 0) + 1
    for batch in batches:
        columns = [list_values(batch.column(i)) for i in range(1, 7)]
        rows = []
        for row in range(batch.num_rows):
            ids, n_words, terms, starts, docs, positions = [v[b[row]:b[row + 1]] for v, b in columns]
            segment = Segment(n_words, terms, starts, docs, positions, gap)
            window, start = segment.phrases(windows)
            line = np.zeros(segment.base[-1] + 1, np.int32)
            np.add.at(line, start, 1)
            np.add.at(line, start + windows.lengths[window], -1)
            edges = np.flatnonzero(np.diff((np.cumsum(line) > 0).astype(np.int8), prepend=0))
            items = _items_by_doc(segment, window, start, windows)
            close = _items_by_doc(segment, *segment.near(windows, slop), windows) if slop is not None else {}
            owner = np.searchsorted(segment.base, edges, "right") - 1
            cuts = np.searchsorted(owner, np.arange(len(n_words) + 1))
            ids = batch.column(1)[row].as_py()
            number = batch.column(0)[row].as_py()
            for doc, doc_id in enumerate(ids):
                spans = (edges[cuts[doc]:cuts[doc + 1]] - segment.base[doc]).tolist() if doc in items else []
                rows.append((
                    number, doc, doc_id, int(n_words[doc]), spans, items.get(doc, []), close.get(doc, []),
                ))
        names = [part.partition(" ")[0] for part in _FOUND_DDL.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        for at in range(0, len(rows), 5000):
            data = [pa.array(c, k) for c, k in zip(zip(*rows[at:at + 5000]), kinds)]
            yield pa.RecordBatch.from_arrays(data, names)


def _items_by_doc(segment: Segment, window: np.ndarray, start: np.ndarray, windows: Windows) -> dict[int, list[str]]:
    doc = np.searchsorted(segment.base, start, "right") - 1
    found: dict[int, set[str]] = {}
    for d, item in set(zip(doc.tolist(), windows.items[window].tolist())):
        found.setdefault(d, set()).add(item)
    return {d: sorted(items) for d, items in found.items()}


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Where test items occur in `docs`: doc_id, n_words, spans (maximal runs of hit words, as flat pairs of first word
    and end), items whose windows occur exactly and, with `slop`, near_items whose windows occur with all words in any
    order within `slop` more places. One row per document, repeated ones included.

    A-Z are lower-cased; words are runs of letters, digits and characters beyond ASCII. Null and empty texts have no
    words and no hits; an item without words is never found. Columns other than doc_id (bigint) and text, and item_id
    and text, are not read. The test windows are sent to all tasks, at most `WINDOWS_A_PASS` of them in one pass. All
    passes search one written index, over the terms of all windows, so a document has the same place in each.
    """
    spark = docs.sparkSession
    runs = test_windows(benchmark, window)
    passes = max(1, -(-runs.count() // WINDOWS_A_PASS))
    vocabulary = runs.select(F.explode("terms").alias("term")).distinct().toArrow().column("term").to_numpy()
    index = build_index(docs, np.sort(vocabulary))
    found = []
    for number in range(passes):
        own = runs.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == number).collect()
        terms = np.full((len(own), window), -1, np.int64)
        for row, run in enumerate(own):
            terms[row, :len(run["terms"])] = run["terms"]
        windows = Windows(
            terms, np.array([len(run["terms"]) for run in own], np.int64),
            np.array([run["item"] for run in own], object),
        )
        shared = spark.sparkContext.broadcast(windows)
        found.append(index.mapInArrow(lambda batches, w=shared: _search(batches, w.value, slop), _FOUND_DDL))
    if passes == 1:
        return found[0].drop("segment", "ordinal")
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    merged = together.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    hit = F.expr(
        "array_sort(array_distinct(flatten(transform(sequence(0, cast(size(pairs) / 2 as int)), "
        "i -> if(2 * i < size(pairs), sequence(pairs[2 * i], pairs[2 * i + 1] - 1), array())))))"
    )
    spans = F.expr(
        "flatten(transform(hits, h -> filter(array(if(array_contains(hits, h - 1), null, h), "
        "if(array_contains(hits, h + 1), null, h + 1)), e -> e is not null)))"
    )
    return merged.withColumn("hits", hit).select("doc_id", "n_words", spans.alias("spans"), "items", "near_items")


def judged(found: DataFrame) -> DataFrame:
    """`find`'s rows as doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when at least one in twenty of its words is hit.
    """
    hit = F.expr(
        "aggregate(sequence(0, size(spans)), 0L, (sum, i) -> "
        "sum + if(i < size(spans), if(i % 2 = 0, -spans[i], spans[i]), 0L))"
    )
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns. Rows are told apart by id and text."""
    key = F.xxhash64(docs["doc_id"].cast("string"), docs["text"])
    keyed = docs.select(key.alias("doc_id"), "text")
    bad = judged(find(keyed, benchmark, **options)).filter("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    bad = saved(bad, "contaminated")
    return docs.join(bad, key == bad["bad"], "left_anti")
