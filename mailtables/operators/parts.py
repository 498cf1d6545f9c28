"""Files that lie beside an XML message: its body parts and its attachments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailtables.functions.text import decode_bytes, file_name, html_to_text, looks_like_html, parent_dir, strip
from mailtables.sources.kinds import ATTACHMENT_DIR, BODY_PART

def _task_cut(group: str, amount: str, cap: int):
    """The cut of one task's rows, sorted by group and order: a row stays while the amounts before it in its group,
    within the task, stay below `cap` and its own amount is above 0. Only group and amount are read in Python; the
    other columns stay in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = object(), 0
        for batch in batches:
            groups = batch.column(group).to_pylist()
            amounts = batch.column(amount).to_pylist()
            keep = []
            for g, a in zip(groups, amounts):
                if g != current or (g is None) != (current is None):
                    current, running = g, 0
                keep.append(running < cap and a is not None and a > 0)
                running += a or 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def take_until(rows: DataFrame, group: str, order: str, amount: str, cap: int) -> DataFrame:
    """Per group, rows in `order` while the amounts before a row stay below `cap`; rows of amount 0 (or null) are left
    out.

    A row that is cut among some of its group's rows is cut among all of them. So each task first cuts its own rows,
    sorted in place (no shuffle), and hands on at most `cap` worth and one row more of every group; one shuffle by
    group follows, and a window over what is left makes the final cut. A group that holds a third of the data sends
    at most that prefix from each task.
    """
    staged = rows.sortWithinPartitions(group, order)
    cut = staged.mapInArrow(_task_cut(group, amount, cap), staged.schema)
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_before", F.coalesce(F.sum(amount).over(before), F.lit(0)))
    return cut.where((F.col("_before") < cap) & (F.col(amount) > 0)).drop("_before")


def part_texts(files: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """Part files (path, content) to (dir, name, text): decoded, and HTML turned to text; whole, or the first bytes."""
    content = F.col("content") if part_bytes is None else F.substring("content", 1, part_bytes)
    parts = files.where(F.col("path").rlike(BODY_PART)).select(
        parent_dir(F.col("path")).alias("dir"),
        file_name(F.col("path")).alias("name"),
        decode_bytes(content).alias("text"),
    )
    is_html = looks_like_html(F.col("text"))
    markup = html_to_text(F.when(is_html, F.col("text")))
    return parts.withColumn("text", F.coalesce(markup, F.col("text")))


def bodies_from_parts(parts: DataFrame, cap: int | None = None) -> DataFrame:
    """(dir, body): the trimmed parts in name order, blank ones left out, joined by a blank line; whole, or cut to `cap`.

    With a cap, parts are taken until their untrimmed lengths reach it. More than `cap` characters of one part can
    never show, so only that much of it travels.
    """
    piece = strip(F.col("text")) if cap is None else F.substring(strip(F.col("text")), 1, cap)
    pieces = parts.select("dir", "name", F.length("text").alias("chars"), piece.alias("piece"))
    if cap is not None:
        pieces = take_until(pieces, "dir", "name", "chars", cap)
    ordered = F.array_sort(F.collect_list(F.struct("name", "piece")))
    joined = F.array_join(F.transform(ordered, lambda part: part["piece"]), "\n\n")
    body = joined if cap is None else F.substring(joined, 1, cap)
    return pieces.where(F.col("piece") != "").groupBy("dir").agg(body.alias("body"))


def attachment_lists(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(dir, attachments): the names of each attachment folder, or its first ones, XML files then left out.

    The rank filter keeps only `limit` rows per folder and task before the shuffle.
    """
    listed = first_names(
        files.where(file_name(parent_dir(F.col("path"))) == ATTACHMENT_DIR).select(
            parent_dir(parent_dir(F.col("path"))).alias("dir"),
            file_name(F.col("path")).alias("name"),
            "size_bytes",
        ),
        "dir",
        "name",
        limit,
    )
    attachment = F.struct(
        F.col("name").alias("filename"),
        F.lit(None).cast("string").alias("content_type"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
    )
    kept = listed.where(~F.lower("name").endswith(".xml"))
    return kept.groupBy("dir").agg(F.array_sort(F.collect_list(attachment)).alias("attachments"))


def first_names(files: DataFrame, group: str, name: str, limit: int | None) -> DataFrame:
    """The first `limit` rows of each group by name; all of them without a limit."""
    if limit is None:
        return files
    rank = F.row_number().over(Window.partitionBy(group).orderBy(name))
    return files.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
