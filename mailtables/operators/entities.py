"""E-mail, date and money entities with character offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.functions.patterns import DATE_JAVA, EMAIL_JAVA, MONEY_JAVA
from mailtables.schema import ENTITY

# Label, pattern and characters of which every match contains one, in output order.
KINDS = [("EMAIL", EMAIL_JAVA, "@"), ("DATE", DATE_JAVA, "-/"), ("MONEY", MONEY_JAVA, "$")]


# Matches of one text are numbered in runs of this many, so that a text with very many stays near linear.
_RUN = 1000


def add_entities(
    messages: DataFrame, text: str = "body", model: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Add `entities`, an `array<struct<label,text,start_char,end_char>>`: the model's, then each pattern kind's.

    `model` is an optional pandas UDF from text to that array (its iterator form loads a model once per task).
    Offsets count characters, not bytes. A pattern runs only over texts that hold its fixed character.
    """
    pieces = {f"_{label}": _pieces(F.col(text), pattern, must) for label, pattern, must in KINDS}
    found = [_located(f"_{label}", label) for label, _, _ in KINDS]
    if model is not None:
        found.insert(0, F.coalesce(model(F.col(text)), _none()))
    # In two steps, so that a text is searched once and its pieces are used several times.
    return messages.withColumns(pieces).withColumn("entities", F.concat(*found)).drop(*pieces)


def entity_rows(messages: DataFrame) -> DataFrame:
    """One row per entity of messages with an `entities` column."""
    # The outer form, as the inner one filters on the array's size first and so computes it twice.
    return messages.select("message_id", F.inline_outer("entities")).where(F.col("label").isNotNull())


def _none() -> Column:
    return F.array().cast(f"array<{ENTITY}>")


_CUT, _OTHER = "\x01", "\x02"


def _pieces(text: Column, pattern: str, must: str) -> Column:
    """The text cut before and after each match: gap, match, gap, ..., gap. NULL where no match can be.

    Cut marks are put around the matches and the text is split there. A mark that the text already holds is
    made another control character, which neither moves nor makes a match.
    """
    possible = F.contains(text, F.lit(must[0]))
    for character in must[1:]:
        possible = possible | F.contains(text, F.lit(character))
    free = F.when(F.contains(text, F.lit(_CUT)), F.translate(text, _CUT, _OTHER)).otherwise(text)
    return F.when(possible, F.split(F.regexp_replace(free, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1))


def _located(pieces: str, label: str) -> Column:
    """The matches among the pieces with their offsets, summed up piece by piece.

    The match of index i is piece 2i+1 and the gap before it is piece 2i. Written as SQL text, which reaches
    Spark in one call where the same columns take hundreds.
    """
    begin = f"state.pos + length({pieces}[2 * i])"
    end = f"{begin} + length({pieces}[2 * i + 1])"
    one = f"""(state, i) -> struct(
        {end} AS pos,
        concat(state.out, array(struct(
            '{label}' AS label, {pieces}[2 * i + 1] AS text, {begin} AS start_char, {end} AS end_char))) AS out)"""
    count = f"int(size({pieces}) div 2)"
    nothing = f"cast(array() AS array<{ENTITY}>)"
    few = f"aggregate(sequence(0, {count} - 1), struct(0 AS pos, {nothing} AS out), {one}).out"
    many = f"""flatten(transform(
        aggregate(
            sequence(0, {count} - 1, {_RUN}),
            cast(array() AS array<struct<pos:int,out:array<{ENTITY}>>>),
            (done, first) -> concat(done, array(aggregate(
                sequence(first, least(first + {_RUN - 1}, {count} - 1)),
                struct(coalesce(get(done, size(done) - 1).pos, 0) AS pos, {nothing} AS out),
                {one})))),
        r -> r.out))"""
    return F.expr(f"CASE WHEN {count} > {_RUN} THEN {many} WHEN {count} > 0 THEN {few} ELSE {nothing} END")
