"""Bytes to text when they are not UTF-8: the charset is told from the bytes themselves.

Valid UTF-8 stays a native cast. Only the other rows reach one vectorized (pandas) stage, where each candidate
charset's strict decoder is the validity automaton: a multi-byte code (Shift-JIS, GB18030) fails on lead and trail
bytes out of place, so most wrong candidates drop out at once. The decodings that remain are weighed by how plausible
their characters are as text: the share of letters that are common in their script (Cyrillic letters of Russian,
kana, the first level of GB2312 Hanzi, ASCII letters, Latin-1 letters in moderation), less control and unassigned
characters, words that mix scripts, and Latin text that is mostly accented (what Cyrillic single-byte text looks like
read as Windows-1252). The best decoding wins; below `LEAST_SCORE` the bytes fall back to Latin-1, as before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Tried in this order; an equal score goes to the earlier one.
CANDIDATES = ("shift_jis", "gb18030", "cp1251", "cp1252")
FALLBACK = "iso-8859-1"
LEAST_SCORE = 0.5


def _level_one() -> np.ndarray:
    """Hanzi of the first level of GB2312 (the 3,755 most common), as a mask over U+4E00 to U+9FFF."""
    mask = np.zeros(0xA000 - 0x4E00, dtype=bool)
    for lead in range(0xB0, 0xD8):
        for trail in range(0xA1, 0xFF):
            try:
                code = ord(bytes((lead, trail)).decode("gb2312"))
            except UnicodeDecodeError:
                continue
            if 0x4E00 <= code < 0xA000:
                mask[code - 0x4E00] = True
    return mask


_LEVEL_ONE = _level_one()
# scripts: 0 none, 1 Latin, 2 Greek, 3 Cyrillic, 4 CJK (kana, Hanzi, half-width kana), 5 Hangul
_RANGES = [
    (0x41, 0x5B, 1), (0x61, 0x7B, 1), (0xC0, 0xD7, 1), (0xD8, 0xF7, 1), (0xF8, 0x250, 1), (0x370, 0x400, 2),
    (0x400, 0x530, 3), (0x3041, 0x3097, 4), (0x30A1, 0x30FB, 4), (0x3400, 0x4DC0, 4), (0x4E00, 0xA000, 4),
    (0xFF66, 0xFFA0, 4), (0xAC00, 0xD7B0, 5),
]


def plausibility(text: str) -> float:
    """A score of how much a decoded text looks like text; higher is likelier, 1 at most. Vectorized over code
    points: the share of letters that are common in their script, less control and unassigned characters (twice),
    less the share of words that mix scripts, less 0.5 for Latin text whose letters are mostly accented."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("int64")
    if not len(codes):
        return 1.0
    script = np.zeros(len(codes), dtype="int8")
    for low, high, kind in _RANGES:
        script[(codes >= low) & (codes < high)] = kind
    letters = script > 0
    bad = int((((codes < 0x20) & ~np.isin(codes, (9, 10, 12, 13))) | ((codes >= 0x7F) & (codes < 0xA0))
               | ((codes >= 0xE000) & (codes < 0xF900)) | (codes == 0xFFFD)).sum())
    n = int(letters.sum())
    if not n:
        return 1.0 - bad / len(codes)
    common = np.where(codes < 0x80, 1.0, 0.0)
    common = np.where((script == 1) & (codes >= 0x80), 0.8, common)
    common = np.where((codes >= 0x410) & (codes < 0x450) | (codes == 0x401) | (codes == 0x451), 1.0, common)
    common = np.where((codes >= 0x3041) & (codes < 0x3097) | (codes >= 0x30A1) & (codes < 0x30FB), 1.0, common)
    hanzi = (codes >= 0x4E00) & (codes < 0xA000)
    level = np.zeros(len(codes), dtype=bool)
    level[hanzi] = _LEVEL_ONE[codes[hanzi] - 0x4E00]
    common = np.where(hanzi, np.where(level, 1.0, 0.3), common)
    common = np.where(letters & (common == 0), 0.1, common)
    starts = np.flatnonzero(letters & ~np.concatenate(([False], letters[:-1])))
    # a word's slice runs to the next word's start; what lies between is no letter, so it counts neither way
    low = np.minimum.reduceat(np.where(letters, script, 127), starts)
    high = np.maximum.reduceat(script, starts)
    mixed = float((low != high).sum()) / len(starts)
    latin = int((script == 1).sum())
    accented = int(((script == 1) & (codes >= 0x80)).sum())
    score = float(common[letters].sum()) / n - 2 * bad / len(codes) - mixed
    if latin > n / 2 and accented > 0.4 * latin:
        score -= 0.5
    return score


def detect(data: bytes) -> tuple[str, str]:
    """(charset, text) for bytes that are not UTF-8: the most plausible strict decoding, else Latin-1."""
    best = (LEAST_SCORE, FALLBACK, data.decode(FALLBACK))
    for place, charset in enumerate(CANDIDATES):
        try:
            text = data.decode(charset)
        except UnicodeDecodeError:
            continue
        score = plausibility(text)
        if score > best[0] or (score == best[0] and best[1] != FALLBACK and place < CANDIDATES.index(best[1])):
            best = (score, charset, text)
    return best[1], best[2]


_DETECTED = StructType([StructField("charset", StringType()), StructField("text", StringType())])


@F.pandas_udf(_DETECTED)
def _detected(contents: pd.Series) -> pd.DataFrame:
    found = [detect(bytes(c)) if c is not None else (None, None) for c in contents]
    return pd.DataFrame(found, columns=["charset", "text"])


def decode_detected(content: Column) -> Column:
    """struct(charset, text): `utf-8` and the cast for valid UTF-8, else the detected charset and its text.

    Null bytes give nulls; empty bytes are valid UTF-8. Only rows that are not UTF-8 go through Python.
    """
    utf8 = content.cast("string")
    valid = F.is_valid_utf8(utf8)
    other = _detected(F.when(~valid, content))
    return F.when(content.isNull(), F.lit(None).cast(_DETECTED)).when(
        valid, F.struct(F.lit("utf-8").alias("charset"), utf8.alias("text"))
    ).otherwise(other)
