"""Search text with AND, OR, NOT, parentheses and quotes, turned into one condition over the message fields.

`invoice AND (Acme OR Contoso)`: NOT binds tightest, then AND, then OR; terms side by side are joined by AND; a
quoted term keeps its blanks and operator words (`"AND or"`), and `\\"` stands for a quote inside it. Only upper-case
AND, OR, NOT are operators. Each term is a `LIKE '%term%'` over subject and body (`%` and `_` stay wildcards, ASCII
letters fold). A malformed text (an operator without operand, a parenthesis left open or never opened, an open
quote, nothing at all) raises ValueError while the plan is built, before any job runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column

from mailtables.plans.search import matches

_TOKEN = re.compile(r'\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()"]+))')
_OPERATORS = ("AND", "OR", "NOT")


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) pairs: `(`, `)`, an operator, or a term."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match or match.end() == at:
            raise ValueError(f"search text cannot be read at {at}: {text[at:at + 20]!r}")
        opened, closed, quoted, word = match.groups()
        if opened:
            found.append(("(", "("))
        elif closed:
            found.append((")", ")"))
        elif quoted is not None:
            found.append(("term", re.sub(r"\\(.)", r"\1", quoted)))
        elif word in _OPERATORS:
            found.append((word, word))
        else:
            found.append(("term", word))
        at = match.end()
    return found


def parse(text: str):
    """The search text as a tree: ("term", text), ("not", x), ("and", [x, ...]), ("or", [x, ...])."""
    items = tokens(text)
    place = 0

    def peek():
        return items[place][0] if place < len(items) else None

    def take(kind):
        nonlocal place
        if peek() != kind:
            raise ValueError(f"search text: {kind!r} expected at token {place + 1} of {text!r}")
        place += 1
        return items[place - 1][1]

    def either():
        parts = [both()]
        while peek() == "OR":
            take("OR")
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both():
        parts = [negated()]
        while peek() in ("AND", "NOT", "term", "("):
            if peek() == "AND":
                take("AND")
            parts.append(negated())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def negated():
        if peek() == "NOT":
            take("NOT")
            return ("not", negated())
        if peek() == "(":
            take("(")
            inner = either()
            take(")")
            return inner
        return ("term", take("term"))

    tree = either()
    if place != len(items):
        raise ValueError(f"search text: unexpected {items[place][1]!r} in {text!r}")
    return tree


def condition(text: str, fields: Sequence[str] = ("subject", "body")) -> Column:
    """One Column for the whole search text."""

    def build(node) -> Column:
        kind, value = node
        if kind == "term":
            return matches(value, fields)
        if kind == "not":
            return ~build(value)
        built = [build(v) for v in value]
        result = built[0]
        for other in built[1:]:
            result = (result & other) if kind == "and" else (result | other)
        return result

    return build(parse(text))
