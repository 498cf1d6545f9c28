"""Rows that every operator has to take."""

#: Nulls everywhere, empty and white-space texts, repeated rows, ties, a long text, letters beyond ASCII.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "One two three", "b"), (4, "One two three", "b"),
    (None, "One two three", "b"), (5, "one TWO three", None), (6, "é" * 50, ""), (7, "word " * 30_000, "a"),
    (8, "One two three", "a"), (9, "x", None), (9, "another text of this id", None),
]
