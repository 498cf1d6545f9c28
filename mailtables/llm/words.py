"""Words of whole texts as 64-bit numbers, for many texts at once, in slices of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """The SplitMix64 finalizer: a one-to-one scrambling of 64-bit numbers."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def numbered(count: int, seed: int) -> np.ndarray:
    """`count` fixed pseudo-random odd numbers."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


class WordKind:
    """Which bytes make up words. A-Z count as a-z; bytes from 128 on belong to words."""

    def __init__(self, separators: list[range]):
        self.in_word = np.ones(256, bool)
        for codes in separators:
            self.in_word[codes.start:codes.stop] = False
        letters = np.arange(256)
        letters[65:91] += 32
        self.in_word[65:91] = self.in_word[97:123]
        self.numbers = numbered(256, 1)[letters]


#: Anything but space and the control characters 9 to 13.
SPACED = WordKind([range(0x09, 0x0E), range(0x20, 0x21)])
#: Letters, digits and everything beyond ASCII.
PLAIN = WordKind([range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)])

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(which: str, count: int) -> np.ndarray:
    """Powers of the multiplier or of its inverse modulo 2^64; kept, and doubled as longer slices come."""
    table = _powers[which]
    if len(table) < count:
        base = _MULTIPLIER if which == "up" else _INVERSE
        while len(table) < count:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
        _powers[which] = table
    return table[:count]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, and where each row starts (and the last one ends). Null has none."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[starts[0]:starts[-1]], starts - starts[0]


def words(column: pa.Array, kind: WordKind) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word of all rows in turn, and where each row's words start (and the last one's end).

    A word's number is a polynomial over its bytes' numbers, from prefix sums modulo 2^64, scrambled with its length.
    """
    data, rows = text_bytes(column)
    total, at, size = len(data), 0, SLICE
    numbers, places = [], []
    while at < total:
        end = min(at + size, total)
        piece = data[at:end]
        inside = kind.in_word[piece]
        fresh = np.zeros(len(piece) + 1, bool)  # a row starts here
        fresh[rows[np.searchsorted(rows, at):np.searchsorted(rows, end, "right")] - at] = True
        fresh[0] = True
        before = np.concatenate([[False], inside])
        starts = np.flatnonzero(inside & (fresh[:-1] | ~before[:-1]))
        stops = np.flatnonzero(inside & (fresh[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        following = end
        if end < total and len(starts) and stops[-1] == len(piece) and not fresh[-1]:
            if starts[-1] == 0:  # one word fills the slice
                size *= 2
                continue
            following = at + starts[-1]
            starts, stops = starts[:-1], stops[:-1]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(kind.numbers[piece] * _power_table("up", len(piece)), out=sums[1:])
        value = (sums[stops] - sums[starts]) * _power_table("down", len(piece))[starts]
        numbers.append(mixed(value + (stops - starts).astype(np.uint64) * np.uint64(_MULTIPLIER)))
        places.append(starts + at)
        at, size = following, SLICE
    if not numbers:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    return np.concatenate(numbers), np.searchsorted(np.concatenate(places), rows)


def pieces(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """Slices of a batch whose texts have about `limit` bytes together, one row at least."""
    _, rows = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(rows, rows[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column from flat values and where each row's values start."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of `lists`, for a column without nulls."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[bounds[0]:bounds[-1]], bounds - bounds[0]
