"""Mixing sources to target weights by weighted fair queueing. Native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailtables.llm.ranks import range_sorted, running_total, shuffle_number
from mailtables.llm.stored import lookup, packed, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
_BLOCK_BITS = 16  # rows of a sorted partition are summed in blocks of this many bits before the cut is looked for


def word_count(text: Column) -> Column:
    """Runs of anything but space and the control characters 9 to 13; null has none.

    Each run becomes one letter and the white space between is taken out, so no list of words is held.
    """
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\f\r", "")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """One row per source: `source`, `source_rows`, `source_size`, `queue` (its place by code point, null last),
    `weight`, `budget` (of the whole mix) and `target`.

    Targets are `weight * level` but at most `repeats` times the source's size. The level is found by going through
    the sources in the order in which they run dry: it is the first one that the next source can still follow. The
    windows run over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("queue", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, (F.col("queue") - 1) % len(weights) + 1))
    all_rows = Window.partitionBy()
    sources = sources.withColumns({
        "most": F.col("source_size") * repeats,
        "budget": F.sum("source_size").over(all_rows) * F.lit(float(share)),
        "weights": F.sum("weight").over(all_rows),
    }).withColumn("dry", F.col("most") / F.col("weight"))
    drying = Window.orderBy("dry", "queue").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("most").over(drying), F.lit(0))
    gone = F.coalesce(F.sum("weight").over(drying), F.lit(0))
    sources = sources.withColumn("level", (F.col("budget") - spent) / (F.col("weights") - gone))
    followed = F.when(F.col("level") <= F.col("dry"), F.struct("dry", "queue", "level"))
    sources = sources.withColumn("level", F.min(followed).over(all_rows)["level"])
    target = F.least(F.coalesce(F.col("weight") * F.col("level"), F.col("most")), F.col("most"))
    return sources.select(
        "source", "source_rows", "source_size", "queue", "weight", "budget", target.cast("double").alias("target")
    )


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies (0 to `repeats`), taken.

    Each source's documents are shuffled by `seed` and queued, `repeats` times over. A document's virtual finish time
    is the source's cumulative words up to its end, divided by the source's weight. All queues are sorted together by
    that time over all partitions, and documents are taken while their words fit into `share` times all words. A
    source that runs dry leaves its turns to the others, which is how the excess is shared again.

    Sources go by code point (null last, a source of its own) and take `weights` in turn. Documents are taken whole,
    so a source is off its target by about a document. Null and empty texts have size 0. Ties of the shuffle go by id
    and size; repeated rows are documents of their own. An empty table gives an empty result. Columns other than
    doc_id, source and text are not read.
    """
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = saved(source_targets(sizes, weights, share, repeats), "mix-sources")
    rows = sizes.withColumns({
        "shuffled": shuffle_number(F.col("doc_id"), seed),
        "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
    })
    joined = rows.join(lookup(sources, "source").withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    queued = running_total(joined.drop("name"), "queue", "source_rows", ["shuffled", "id", "size"], "size")
    queued = saved(queued, "mix-queued")
    order = ["finish", "queue", "copy", "shuffled", "id", "size"]
    finish = ((F.col("source_size") * F.col("copy") + F.col("total")) / F.col("weight")).alias("finish")
    entries = queued.select("*", F.explode(F.array(*[F.lit(k) for k in range(repeats)])).alias("copy"))
    last = _last_taken(range_sorted(entries.select(finish, *order[1:], "budget"), order, "mix-sorted"), order)
    taken = F.lit(0)
    for copy in range(repeats):
        entry = queued_entry(copy)
        fits = F.lit(False) if last is None else entry <= F.struct(*[F.lit(last[c]).alias(c) for c in order])
        taken = taken + fits.cast("int")
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("copies"),
        (F.col("size") * taken).cast("bigint").alias("taken"),
    )


def queued_entry(copy: int) -> Column:
    """A queued document's sort key, for one of its copies."""
    finish = (F.col("source_size") * F.lit(copy) + F.col("total")) / F.col("weight")
    return F.struct(finish.alias("finish"), "queue", F.lit(copy).alias("copy"), "shuffled", "id", "size")


def _last_taken(entries: DataFrame, order: list[str]):
    """The last entry whose running total, over all sorted partitions, is within the budget; None if none is.

    Sums of blocks of rows are added up first, one row per block; only the block where the budget ends is looked into.
    """
    block = F.shiftright("row", _BLOCK_BITS).alias("block")
    blocks = entries.groupBy("part", block).agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    up_to = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("total", F.sum("words").over(up_to))
    over = blocks.filter("total > budget").orderBy("part", "block").first()
    if over is None:
        return entries.orderBy(*[F.desc(c) for c in order]).first()
    room = over["budget"] - (over["total"] - over["words"])
    inside = entries.filter((F.col("part") == over["part"]) & (block == over["block"]))
    inside = inside.withColumn("total", F.sum("size").over(Window.partitionBy("part").orderBy("row")))
    last = inside.filter(F.col("total") <= room).orderBy(F.desc("row")).first()
    if last is not None:
        return last
    before = entries.filter(F.struct("part", "row") < F.struct(F.lit(over["part"]), F.lit(over["block"] << _BLOCK_BITS)))
    return before.orderBy(F.desc("part"), F.desc("row")).first()


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: every row of `docs` as often as `plan_mix` takes it, same columns.

    Rows that share id, source and size (repeated rows) are all taken as often as the one taken most.
    """
    plan = plan_mix(docs, **options).filter("copies > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    plan = plan.select(*[F.col(c).alias(f"mix_{c}") for c in plan.columns])
    rows = packed(docs, "doc")
    same = [F.col(f"doc.{c}").eqNullSafe(F.col(f"mix_{c}")) for c in ("doc_id", "source")]
    joined = rows.join(plan, [*same, word_count(F.col("doc.text")) == F.col("mix_size")])
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("doc.*")
