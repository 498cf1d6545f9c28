"""Regular expressions: the fixed entity patterns and their Java form.

The patterns are written in Python's dialect, because rule files are too. Spark runs Java's engine, whose
`\\d \\w \\s \\b` and case folding are ASCII by default, so `to_java` spells out what they mean in Python.
"""

from __future__ import annotations

import re

# The three entity patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
MONEY = r"\$\s?\d{1,3}(,\d{3})*(\.\d{2})?\b"

# The characters Python's str.strip() removes and its \s matches.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1C-\x1F\x85\p{Z}"
_JAVA = {
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "w": f"[{_WORD}]",
    "W": f"[^{_WORD}]",
    "s": f"[{_SPACE}]",
    "S": f"[^{_SPACE}]",
    "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
    "B": f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))",
    "Z": r"\z",
}


def to_java(pattern: str, starts: str = "") -> str:
    """The same pattern for Java: Unicode classes, `.` and `$` know only `\\n`, `(?i)` folds Unicode.

    A pattern that Python itself refuses raises here, when the rules are loaded. `starts` may name the class of
    the first character of every match, which saves looking for word boundaries elsewhere.
    """
    pattern = f"(?={starts}){pattern}" if starts else pattern
    re.compile(pattern)
    java = re.sub(r"\\(.)", lambda m: _JAVA.get(m[1], m[0]), pattern, flags=re.S)
    java = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", java)
    return "(?du)" + re.sub(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", r"\\k<\1>", java)


# A run of local-part characters can only start a match at its first character or where the previous match
# ended (\G). Saying so finds the same matches and keeps long runs without '@' (encoded data) linear.
EMAIL_JAVA = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + EMAIL
DATE_JAVA = to_java(DATE, starts=r"\d")
MONEY_JAVA = to_java(MONEY)
