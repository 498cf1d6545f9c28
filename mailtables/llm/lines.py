"""Line dedup: repeated runs of lines, found by prefix doubling over line names, lose their later copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailtables.llm.ranks import range_sorted
from mailtables.llm.stored import saved

RUN_LINES = 3
_LAST = (1 << 63) - 1


def with_text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty), `place` (doc_id, or last without one) and t1, t2, which stand for the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("place"),
        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"),
    )


def _ranked(rows: DataFrame, label: str) -> DataFrame:
    """node, pos, rank of the rows whose names `a`, `b` another row has too; ranks follow the order of the names.

    Names are counted, partly before the shuffle; those met once are out, as they end every repeated run. The others
    are range-sorted, and partition and place make the rank, so no task sees all names.
    """
    repeated = rows.groupBy("a", "b").agg(F.count("*").alias("members")).filter("members > 1").select("a", "b")
    order = range_sorted(repeated, ["a", "b"], label)
    order = order.select("a", "b", (F.shiftleft("part", 33) + F.col("row")).alias("rank"))
    return saved(rows.join(order, ["a", "b"]).select("node", "pos", "rank"), label)


def repeated_windows(lines: DataFrame, width: int) -> DataFrame:
    """node, pos, rank of every run of `width` lines that occurs more than once; equal runs have equal ranks.

    `lines` has node, pos and the line's names `a`, `b`. This is the suffix array as deep as it is needed: suffixes
    are ranked by one line, then by two, four and so on, a rank being that of the pair of its halves (the last pair
    overlaps to end at `width`). Classes of a round are the intervals of suffixes with so long a common prefix.
    """
    ranked, done = _ranked(lines, "lines-1"), 1
    while done < width:
        step = min(done, width - done)
        there = Window.partitionBy("node").orderBy("pos").rangeBetween(step, step)
        pairs = ranked.select("node", "pos", F.col("rank").alias("a"), F.max("rank").over(there).alias("b"))
        done += step
        ranked = _ranked(pairs.filter("b IS NOT NULL"), f"lines-{done}")
    return ranked


def later_starts(windows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, starts: where each node has a window that another place has before it, by (place, node, pos).

    `windows` has node, pos and rank; `nodes` has node and place.
    """
    placed = windows.join(nodes.select("node", "place"), "node")
    here = F.struct("place", "node", "pos")
    firsts = saved(placed.groupBy("rank").agg(F.min(here).alias("first")), "first-windows")
    later = placed.join(firsts, "rank").filter(here > F.col("first"))
    return later.groupBy("node").agg(F.collect_set("pos").alias("starts"))


def text_classes(rows: DataFrame, *values: str) -> DataFrame:
    """One node per different text of `rows` (place, t1, t2 and values that follow from the text); its first place."""
    own = F.min_by(F.struct(*values), "place").alias("own")
    classes = rows.groupBy("t1", "t2").agg(F.min("place").alias("place"), F.count("*").alias("copies"), own)
    return saved(classes.select("*", "own.*").drop("own").withColumn("node", F.monotonically_increasing_id()), "text-classes")


def covered(starts: list[int] | None, count: int, width: int, every: bool) -> list[bool]:
    """Which of `count` units windows of `width` units cover: those at `starts`, or all of them."""
    marks = [False] * count
    for start in range(count - width + 1) if every else starts or ():
        marks[start:start + width] = [True] * width
    return marks


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, texts: bool = True) -> DataFrame:
    """Each document without the lines of repeated runs whose copy comes earlier.

    doc_id, n_lines, n_removed, n_runs (maximal removed runs), kept_sha256 (of the kept lines joined by line ends) and,
    with `texts`, kept. Lines end at line feeds and are compared whole. A line is removed if it lies in a run of
    `run_lines` lines of one document that another place has before it, by doc_id (none comes last), then line; so of
    a line repeated many times in a row the first one stays. An empty text is one empty line, and a null text counts
    as empty. Texts of fewer lines stay whole. Rows of one doc_id and text have one result. Columns other than doc_id
    and text are not read. Lines are told apart by 128 bits.
    """
    keyed = with_text_keys(docs)
    names = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("l"), x).alias("b")))
    classes = text_classes(keyed.select("place", "t1", "t2", names.alias("names")), "names")
    lines = classes.filter(F.size("names") >= run_lines).select("node", F.posexplode("names").alias("pos", "name"))
    windows = repeated_windows(lines.select("node", "pos", "name.a", "name.b"), run_lines)
    found = classes.select("node", "t1", "t2", "place", "copies").join(later_starts(windows, classes), "node", "left")
    found = found.filter("copies > 1 OR starts IS NOT NULL")
    found = saved(found.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("place").alias("first"), "starts"), "later-lines")
    same = (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    rows = keyed.join(found.hint("merge"), same, "left")
    rows = rows.select("doc_id", "text", "starts", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("copy"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, copy in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                units = text.split("\n")
                marks = covered(starts, len(units), run_lines, copy)
                kept = "\n".join(unit for unit, gone in zip(units, marks) if not gone)
                runs = sum(gone and not before for gone, before in zip(marks, [False, *marks]))
                out.append((len(units), sum(marks), runs, hashlib.sha256(kept.encode()).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:5 if texts else 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256", "kept"][:len(columns) + 1]
            )

    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines bigint, n_removed bigint, n_runs bigint, kept_sha256 string"
    return rows.mapInArrow(cut, ddl + (", kept string" if texts else ""))
