"""Spelling variants grouped by permuterm rotations. Native columns only.

Each word w of L code points, marked with the terminator `$`, has L + 1 rotations of w$ (`full` keys) and L rotations
with one code point left out (`skip` keys: w[i+1:] $ w[:i], the `$` tells where i was). Two words of one length that
differ in code point i share the skip key i; a word u and a word v made from u by inserting one code point at i share
u's full rotation i and v's skip key i. So every pair at one edit meets under one key, and a key holds at most one
word per code point that can stand in the gap, plus one full rotation: groups stay small however frequent a word is.
A sort of all rotations by key (one shuffle) finds them; counts and the best neighbour come from the group's totals,
so no pair is ever emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailtables.llm.stored import saved

# Fixed values of the contract: the letters of a run, the deleting rule and the word limits.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
_END = "$"  # never inside a run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct edited runs of all texts with at least `least_length` code points and `least_count` uses.

    A run is lower-cased in A-Z only. With h the unsigned CRC-32 of `<doc_id>:<run>` (UTF-8; a null doc_id counts as
    no text), a run whose h is a multiple of 31 loses its code point h % length. A null text has no runs, an empty one
    none either. Counting is a word count: partial sums before the shuffle, so a very frequent word costs no more than
    a rare one. Only doc_id and text are read.
    """
    runs = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), 0),
                    lambda r: F.length(r) >= least_length)
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(owner.alias("owner"), F.explode(runs).alias("run"))
    runs = runs.withColumn("low", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat(F.col("owner"), F.lit(":"), F.col("low")).cast("binary"))
    runs = runs.withColumns({"h": h, "cut": (h % F.length("low")).cast("int")})
    edited = F.when(
        F.col("h") % DELETE_EVERY == 0, F.expr("concat(substring(low, 1, cut), substring(low, cut + 2))")
    ).otherwise(F.col("low"))
    words = runs.select(edited.alias("word"))
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """key, word, n, skip (true: a skip key), first (a skip key whose left-out code point starts a run of equals)."""
    skip_keys = F.expr(
        f"transform(sequence(0, length(word) - 1), i -> named_struct("
        f"'key', concat(substring(word, i + 2), '{_END}', substring(word, 1, i)), 'skip', true, "
        f"'first', i = 0 OR substring(word, i + 1, 1) != substring(word, i, 1)))"
    )
    full_keys = F.expr(
        f"transform(sequence(0, length(word)), i -> named_struct("
        f"'key', concat(substring(word, i + 1), '{_END}', substring(word, 1, i)), 'skip', false, 'first', false))"
    )
    rotated = words.select("word", "n", F.explode(F.concat(skip_keys, full_keys)).alias("r"))
    return rotated.select("r.key", "word", "n", "r.skip", "r.first")


def _best(rows: Column) -> Column:
    """The best neighbour of a group as (-n, word): the largest count, then the smallest word in code-point order."""
    return F.min(F.when(rows, F.struct((-F.col("n")).alias("neg_n"), F.col("word").alias("word"))))


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n for every row of `words` (word, n; distinct words).

    Near words differ by one inserted, deleted or replaced code point. A pair of words meets under one skip key
    (replacement) or, for an insertion into a run of equal code points, under one key per place in the run; only the
    key of the run's first place is counted, so `n_near` counts each near word once. The form is the near word of
    largest n (ties: the smallest word), if its n is at least `factor` times the word's; else null. No word is its own
    form, as its n is below `factor` times itself. Empty input: empty output.
    """
    keys = _rotations(words)
    group = Window.partitionBy("key")
    skip, full = F.col("skip"), ~F.col("skip")
    counted = keys.select(
        "word", "n", "skip", "first",
        F.count(F.when(skip, 1)).over(group).alias("n_skip"),
        F.count(F.when(skip & F.col("first"), 1)).over(group).alias("n_first"),
        F.count(F.when(full, 1)).over(group).alias("n_full"),
        _best(skip).over(group).alias("best_skip"),
        _best(full).over(group).alias("best_full"),
    )
    near = F.when(skip, F.col("n_skip") - 1 + F.when(F.col("first"), F.col("n_full")).otherwise(0)).otherwise(
        F.col("n_first")
    )
    best = F.when(skip, F.least("best_skip", "best_full")).otherwise(F.col("best_skip"))
    per_word = counted.groupBy("word", "n").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))
    fits = F.col("best.neg_n") <= -factor * F.col("n")
    return per_word.select(
        "word", "n", F.col("n_near").cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.word")).alias("form"),
        F.when(fits, -F.col("best.neg_n")).cast("bigint").alias("form_n"),
    )


def rooted(forms: DataFrame) -> DataFrame:
    """Add `root` to rows of (word, form): follow forms to a word without one; a word without a form is its own root.

    Pointer doubling: each round joins a word's pointer with the pointer's pointer, so a chain of k forms takes about
    log2(k) rounds; forms grow tenfold in n at each step, so chains are short. Each round is written (lineage stays
    short) and the loop ends when no pointer moves.
    """
    pointers = saved(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = pointers.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = pointers.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")
        )
        moved = saved(moved, "spelling-roots")
        if moved.filter("moved").limit(1).count() == 0:
            break
        pointers = moved.drop("moved")
    return forms.join(moved.drop("moved"), "word")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs` (doc_id, text; other columns are not read)."""
    words = saved(word_counts(docs), "spelling-words")
    return rooted(saved(variants(words), "spelling-forms"))
