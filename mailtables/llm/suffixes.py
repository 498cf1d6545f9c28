"""Suffix-array dedup: long byte strings that start anywhere else as well are taken out of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.llm.jaccard import _cuts, _runs
from mailtables.llm.stored import saved
from mailtables.llm.words import _power_table, lists, mixed, numbered, pieces, text_bytes

LENGTH = 400
#: Bytes of the anchor strings by which places of equal text find each other; at most LENGTH.
GRAM = 160
#: An anchor string of more places is split by what stands before and behind it, so that it is not one task's work.
_HOT = 2000
#: Places matched together, at most. A group that may have more is salted, and its windows are also counted across parts.
_TILE = 12_000
#: Offsets of open windows that are counted by their common bytes first.
_STEP = 16
_SLICE = 1 << 19
_BYTES = numbered(256, 3)
_LOW = np.uint64((1 << 32) - 1)


def _gram_numbers(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit number of each run of `gram` bytes: a polynomial from prefix sums modulo 2^64, scrambled."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power_table("up", len(data)), out=sums[1:])
    starts = len(data) - gram + 1
    return mixed((sums[gram:] - sums[:starts]) * _power_table("down", starts))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of the anchors of texts laid end to end: the least numbered gram of each `length` bytes.

    Which gram of a window is its anchor depends on the window's bytes only (of equal ones, the first), so equal
    windows have equal anchors at equal offsets. Worked through in slices of bounded size.
    """
    places, numbers = [], []
    total, width = len(data), length - gram + 1
    ends = np.repeat(bounds[1:], np.diff(bounds)) if len(data) <= _SLICE else None
    for at in range(0, max(0, total - length + 1), _SLICE):
        piece = data[at:at + _SLICE + length - 1]
        values = _gram_numbers(piece, gram)
        ranked = (values & ~_LOW) | np.arange(len(values), dtype=np.uint64)
        least = _window_minima(ranked, width)
        start = at + np.arange(len(least))
        end = ends[start] if ends is not None else bounds[np.searchsorted(bounds, start, "right")]
        least = least[start + length <= end]
        if len(least):
            least = least[np.concatenate([[True], least[1:] != least[:-1]])]
            found = np.unique((least & _LOW).astype(np.int64))
            places.append(found + at)
            numbers.append(values[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(numbers)[first]


class SuffixArray:
    """Byte rows (suffixes, cut at a common width) sorted within groups, with the common prefixes of neighbours.

    Each row has the polynomial hashes of all its prefixes, so the common prefix of two rows is found by binary search
    and a comparison takes a logarithmic number of steps. Rows are sorted by merging runs, all comparisons of a step
    at once. The common prefixes are then checked byte by byte; if a hash collision misled the order, the rows are
    sorted again by their bytes.
    """

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        self.rows, self.lengths, self.group = rows, lengths, group
        self.hashes = np.zeros((rows.shape[1] + 1, len(rows)), np.uint64)
        for column in range(rows.shape[1]):
            self.hashes[column + 1] = self.hashes[column] * np.uint64(0x9E3779B97F4A7C15) + _BYTES[rows[:, column]]
        self.order = self._sorted()
        common = self._compared()
        if common is None:
            texts = [bytes(row[:n]) for row, n in zip(rows, lengths.tolist())]
            self.order = np.array(sorted(range(len(rows)), key=lambda i: (group[i], texts[i])), np.int64)
            common = self._compared(trusted=False)
        self.common = common

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the common prefix of rows i and j, by their hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes[middle, i] == self.hashes[middle, j]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def _less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        less = self.group[i] < self.group[j]
        same = np.flatnonzero(self.group[i] == self.group[j])
        if len(same):
            a, b = i[same], j[same]
            at = self.extension(a, b)
            ends = (at == self.lengths[a]) | (at == self.lengths[b])
            inner = np.minimum(at, self.rows.shape[1] - 1)
            less[same] = np.where(ends, self.lengths[a] < self.lengths[b], self.rows[a, inner] < self.rows[b, inner])
        return less

    def _sorted(self) -> np.ndarray:
        """Bottom-up mergesort. An item's new place is its place in its run plus the items of the other run before it."""
        count = len(self.rows)
        order, place, width = np.arange(count), np.arange(count), 1
        while width < count:
            run = place // width
            other = run ^ 1
            low = np.minimum(other * width, count)
            first, high = low.copy(), np.minimum((other + 1) * width, count)
            earlier = (run & 1) == 0
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                mine, theirs, mine_first = order[open_], order[middle], earlier[open_]
                ahead = self._less(np.where(mine_first, theirs, mine), np.where(mine_first, mine, theirs))
                before = np.where(mine_first, ahead, ~ahead)  # of equal items the earlier run's come first
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = (run >> 1) * 2 * width + (place - run * width) + (low - first)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, width * 2
        return order

    def _compared(self, trusted: bool = True) -> np.ndarray | None:
        """Common prefix of each sorted row with the one before it in its group (else 0); None if hashes misled."""
        i, j = self.order[:-1], self.order[1:]
        together = np.flatnonzero(self.group[i] == self.group[j])
        common = np.zeros(len(self.rows), np.int64)
        for at in range(0, len(together), 4096):
            some = together[at:at + 4096]
            a, b = i[some], j[some]
            shortest = np.minimum(self.lengths[a], self.lengths[b])
            differ = (self.rows[a] != self.rows[b]) | (np.arange(self.rows.shape[1]) >= shortest[:, None])
            exact = np.where(differ.any(axis=1), differ.argmax(axis=1), self.rows.shape[1])
            if trusted and not np.array_equal(exact, self.extension(a, b)):
                return None
            common[some + 1] = exact
        return common

    def best(self) -> np.ndarray:
        """Each row's longest common prefix with any other row of its group."""
        longest = np.zeros(len(self.rows), np.int64)
        longest[self.order] = np.maximum(self.common, np.append(self.common[1:], 0))
        return longest

    def classes(self, length: int) -> np.ndarray:
        """For each row a number that the rows of its group with the same first `length` bytes share."""
        named = np.empty(len(self.rows), np.int64)
        named[self.order] = np.cumsum(self.common < length)
        return named


def repeated_windows(
    after: np.ndarray, n_after: np.ndarray, before: np.ndarray, n_before: np.ndarray, group: np.ndarray, length: int,
    low: np.ndarray | None = None, high: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and the greatest offset into a window of `length` bytes that another anchor repeats,
    of the offsets from `low` to `high` (alike in a group; all without them).

    `after` has the bytes from the anchor on, `before` those ahead of it, backwards; a window at offset o takes o
    bytes of the one and `length - o` of the other. Two anchors have the window in common when they share the class of
    that length in both suffix arrays. -1 where no window repeats.
    """
    ahead, back = SuffixArray(after, n_after, group), SuffixArray(before, n_before, group)
    least = np.full(len(group), -1, np.int64)
    greatest = least.copy()
    hopeful = ahead.best() + back.best() >= length
    widest = before.shape[1]
    low = np.zeros(len(group), np.int64) if low is None else low
    high = np.full(len(group), widest) if high is None else high
    for offsets, found in ((range(widest, -1, -1), greatest), (range(widest + 1), least)):
        wanted = hopeful & ((greatest >= 0) | (found is greatest))
        for offset in offsets:
            if not (wanted & (found < 0)).any():
                break
            fits = (n_before >= offset) & (n_after >= length - offset) & hopeful & (low <= offset) & (offset <= high)
            fits = np.flatnonzero(fits)
            pair = (ahead.classes(length - offset)[fits] << np.int64(32)) | back.classes(offset)[fits]
            _, place, counts = np.unique(pair, return_inverse=True, return_counts=True)
            shared = fits[counts[place] > 1]
            found[shared[found[shared] < 0]] = offset
    return least, greatest


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


_ANCHOR_DDL = "doc_id string, t1 bigint, t2 bigint, n bigint, numbers array<bigint>, places array<array<bigint>>"
_CONTEXT_DDL = (
    "number bigint, tile bigint, low bigint, high bigint, salts bigint, node bigint, place bigint, lead bigint, "
    "context binary"
)
_FOUND_DDL = "node bigint, begins bigint, ends bigint, w1 bigint, w2 bigint, offset bigint, windows array<bigint>"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, _SLICE):
            data, bounds = text_bytes(part.column(1))
            place, number = anchors(data, bounds, length, gram)
            row = np.searchsorted(bounds, place, "right") - 1
            order = np.lexsort((place, number, row))
            place, number, row = place[order] - bounds[row[order]], number[order], row[order]
            fresh = np.ones(len(place), bool)  # the first place of each different gram of a text
            fresh[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
            firsts = np.flatnonzero(fresh)
            cuts = np.searchsorted(row[firsts], np.arange(part.num_rows + 1))
            nested = pa.ListArray.from_arrays(
                pa.array(cuts.astype(np.int32)), lists(place, np.append(firsts, len(place)))
            )
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), part.column(3), pa.array(np.diff(bounds)),
                lists(number[firsts].view(np.int64), cuts), nested,
            ], ["doc_id", "t1", "t2", "n", "numbers", "places"])


def _content_number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "little")


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows text, node, numbers, places, members: the bytes around each anchor.

    Places of a text with the same bytes around them repeat each other, so they are settled here (no context, a lead
    of -1 less their own) and one of them goes on. A hot anchor goes on as two rows, one for the windows that reach
    far behind it and one for those that reach far ahead, each dealt out by the bytes such windows have in common.
    """
    lead_most = length - gram
    half = lead_most // 2
    names = [part.partition(" ")[0] for part in _CONTEXT_DDL.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    for batch in batches:
        for part in pieces(batch, 0, _SLICE):
            data, bounds = text_bytes(part.column(0))
            columns = [part.column(c).to_pylist() for c in range(1, 5)]
            rows = []
            for at, (node, numbers, places, members) in enumerate(zip(*columns)):
                text = data[bounds[at]:bounds[at + 1]].tobytes()
                for number, own, total in zip(numbers, places, members):
                    salts = -(-total // _TILE)
                    seen: dict[tuple[int, bytes], list[int]] = {}
                    for place in own:
                        lead = min(place, lead_most)
                        seen.setdefault((lead, text[place - lead:place + length]), []).append(place)
                    for (lead, context), alike in seen.items():
                        place = alike[0]
                        if len(alike) > 1 and len(context) >= length:
                            for settled in alike:
                                tile = -1 - (settled + node) % 1024
                                rows.append((number, tile, 0, 0, 1, node, settled, -1 - lead, b""))
                        salt = _content_number(f"{node}:{place}".encode()) % salts
                        if total <= _HOT:
                            rows.append((number, 0, 0, lead_most, 1, node, place, lead, context))
                            continue
                        near, far = context[lead:lead + length - half], context[max(0, lead - half - 1):lead]
                        tile = _content_number(near + b"near" + salt.to_bytes(8, "little"))
                        rows.append((number, tile, 0, half, salts, node, place, lead, context))
                        if lead > half:
                            tile = _content_number(far + b"far" + salt.to_bytes(8, "little"))
                            rows.append((number, tile, half + 1, lead_most, salts, node, place, lead, context))
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _matched(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by number and tile: the repeated bytes around each anchor, and the windows of a split group that
    other parts may have too: those a part leaves open, and one place of each that it has settled."""
    for table in _runs(batches, 2):
        lead = table.column("lead").to_numpy()
        if (settled := np.flatnonzero(lead < 0)).size:
            node, place = (table.column(c).to_numpy()[settled] for c in ("node", "place"))
            begins = place + 1 + lead[settled]
            yield _found(node, begins, place + length)
        cuts = _cuts(table, 2)
        width = np.diff(cuts)
        group = np.repeat(np.arange(len(width)), width)
        # single rows have no one to meet, unless their group has other parts
        kept = np.flatnonzero((lead >= 0) & ((width[group] > 1) | (table.column("salts").to_numpy() > 1)))
        start = 0
        while start < len(kept):  # whole groups, about 4000 rows at a time; a group of more than a tile in parts
            stop = min(start + 4000, len(kept))
            while stop < min(len(kept), start + _TILE) and group[kept[stop]] == group[kept[stop - 1]]:
                stop += 1
            yield from _match_block(table.take(pa.array(kept[start:stop])), group[kept[start:stop]], width, length, gram)
            start = stop


def _found(node, begins, ends, w1=None, w2=None, offset=None, windows=None) -> pa.RecordBatch:
    none = np.zeros(len(node), np.int64)
    columns = [node, begins, ends, *[none if c is None else c for c in (w1, w2, offset)]]
    tail = windows if windows is not None else pa.nulls(len(node), pa.list_(pa.int64()))
    names = ["node", "begins", "ends", "w1", "w2", "offset", "windows"]
    return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], tail], names)


def _match_block(
    table: pa.Table, group: np.ndarray, width: np.ndarray, length: int, gram: int
) -> Iterator[pa.RecordBatch]:
    lead_most = length - gram
    column = table.column("context").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data, bounds = text_bytes(column)
    node, place, lead, low, high = (table.column(c).to_numpy() for c in ("node", "place", "lead", "low", "high"))
    n_after = np.diff(bounds) - lead
    middle = bounds[:-1] + lead
    step = np.arange(length)
    at = np.minimum(middle[:, None] + step, len(data) - 1)
    after = np.where(step < n_after[:, None], data[at], 0).astype(np.uint8)
    step = np.arange(lead_most)
    at = np.maximum(middle[:, None] - 1 - step, 0)
    before = np.where(step < lead[:, None], data[at], 0).astype(np.uint8)
    least, greatest = repeated_windows(after, n_after, before, lead, group, length, low, high)
    found = np.flatnonzero(greatest >= 0)
    yield _found(node[found], place[found] - greatest[found], place[found] - least[found] + length)
    split = np.flatnonzero((table.column("salts").to_numpy() > 1) | (width[group] > _TILE))
    if not len(split):
        return
    ahead, back = _prefix_hashes(after[split]), _prefix_hashes(before[split])
    low, high, least, greatest = low[split], high[split], least[split], greatest[split]
    for first in range(0, lead_most + 1, _STEP):
        last = min(first + _STEP - 1, lead_most)
        offsets = np.arange(first, last + 1)[:, None]
        there = (lead[split] >= offsets) & (n_after[split] >= length - offsets) & (low <= offsets) & (offsets <= high)
        some = np.flatnonzero(there.any(axis=0))
        if not len(some):
            continue
        there = there[:, some].T
        settled = (greatest[some, None] >= 0) & (least[some, None] <= offsets.T) & (offsets.T <= greatest[some, None])
        # all the windows of these offsets hold the bytes from the first one's end back to the last one's begin
        w1 = ahead[length - last][some]
        w2 = mixed(back[first][some] + np.uint64(first + 1))
        own = np.stack([
            mixed(ahead[length - o][some] ^ mixed(back[o][some] + np.uint64(o + 1))) | np.uint64(1) for o in range(first, last + 1)
        ], axis=1).view(np.int64)
        own = np.where(there & (~settled | _first_of_each(group[split[some]], own, there & settled)), own, 0)
        kept = np.flatnonzero(own.any(axis=1))
        if not len(kept):
            continue
        bounds_ = np.arange(len(kept) + 1) * own.shape[1]
        at = split[some[kept]]
        begins = place[at] - first
        yield _found(
            node[at], begins, begins + length, w1[kept].view(np.int64), w2[kept].view(np.int64), np.full(len(at), first),
            lists(own[kept].ravel(), bounds_),
        )


def _first_of_each(group: np.ndarray, windows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Marks, of the `wanted` windows (a row each of a group), one of each different window of a group."""
    marks = np.zeros(windows.shape, bool)
    row, column = np.nonzero(wanted)
    order = np.lexsort((column, windows[row, column], group[row]))
    row, column = row[order], column[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (np.diff(group[row]) != 0) | (np.diff(windows[row, column]) != 0)
    marks[row[fresh], column[fresh]] = True
    return marks


def _prefix_hashes(rows: np.ndarray) -> np.ndarray:
    hashes = np.zeros((rows.shape[1] + 1, len(rows)), np.uint64)
    for column in range(rows.shape[1]):
        hashes[column + 1] = hashes[column] * np.uint64(0xBF58476D1CE4E5B9) + _BYTES[rows[:, column]]
    return mixed(hashes)


def _union(pairs: np.ndarray) -> np.ndarray:
    """Flat begin, end pairs as the maximal runs they cover, flat again."""
    pairs = pairs.reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    reach = np.maximum.accumulate(pairs[:, 1])
    fresh = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[fresh, 0], reach[np.append(fresh[1:], len(pairs)) - 1]], axis=1).ravel()


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """t1, t2 (keys of a whole text) and pairs: begin and end, in bytes, of what is repeated in it; flat, may overlap.

    1. Equal texts form classes by 128 bits. A text of `length` bytes or more that occurs again is repeated whole; one
       of the class goes on, for the others to find.
    2. Every window of `length` bytes has an anchor: one of its grams, picked by its content alone. Only anchors whose
       gram occurs again can be in a repeated window; those get the bytes around them.
    3. The contexts of each gram are sorted forwards and backwards as suffix arrays, which tell which windows repeat.
    4. A gram of very many places is split by the bytes its windows have in common, and salted if that may not be
       enough. Windows that repeat within a part are settled there; the others, and one place of each settled one, are
       counted across parts by 128 bits, first by the bytes that neighbouring windows share, then one by one.

    Texts, and lists as wide as texts, are never broadcast.
    """
    whole = _whole(docs)
    rows = whole.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text", *_text_keys(F.col("text")))
    found = saved(rows.mapInArrow(lambda b: _anchor_rows(b, length, gram), _ANCHOR_DDL), "anchors").filter(F.col("n") >= length)
    classes = found.groupBy("t1", "t2", "n").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"),
        F.min_by(F.struct("numbers", "places"), "doc_id").alias("own"),
    )
    classes = saved(classes.select("*", "own.*").drop("own").withColumn("node", F.monotonically_increasing_id()), "text-classes")
    places = classes.select("node", F.explode(F.arrays_zip("numbers", "places")).alias("at")).select(
        "node", F.col("at.numbers").alias("number"), F.col("at.places").alias("places")
    )
    again = places.groupBy("number").agg(F.sum(F.size("places")).alias("members")).filter("members > 1")
    again = saved(again, "repeated-anchors")
    kept = places.join(again, "number").groupBy("node").agg(F.collect_list(F.struct("number", "places", "members")).alias("at"))
    kept = kept.join(classes.select("node", "first_id", F.col("t1").alias("key1"), F.col("t2").alias("key2")), "node")
    kept = kept.select(
        "node", "first_id", "key1", "key2", F.col("at.number").alias("numbers"), F.col("at.places").alias("places"),
        F.col("at.members").alias("members"),
    )
    kept = saved(kept, "anchored").hint("merge")
    same = (F.col("doc_id") == F.col("first_id")) & (F.col("t1") == F.col("key1")) & (F.col("t2") == F.col("key2"))
    around = rows.join(kept, same).select("text", "node", "numbers", "places", "members")
    around = around.mapInArrow(lambda b: _contexts(b, length, gram), _CONTEXT_DDL)
    around = around.repartition("number", "tile").sortWithinPartitions("number", "tile")
    matched = saved(around.mapInArrow(lambda b: _matched(b, length, gram), _FOUND_DDL), "matched")
    settled = matched.filter("windows IS NULL").select("node", "begins", "ends")
    counted = _across_parts(matched.filter("windows IS NOT NULL"))
    pairs = settled.unionByName(counted).groupBy("node").agg(
        F.flatten(F.collect_set(F.array("begins", "ends"))).alias("pairs")
    )
    names = classes.select("node", "t1", "t2", "n", "copies").join(pairs, "node", "left")
    names = names.filter("copies > 1 OR pairs IS NOT NULL")
    all_of_it = F.when(F.col("copies") > 1, F.array(F.lit(0).cast("bigint"), F.col("n"))).otherwise(F.col("pairs"))
    return saved(names.select("t1", "t2", all_of_it.alias("pairs")), "repeated-spans")


def _across_parts(left: DataFrame) -> DataFrame:
    """The handed-on windows that also start at another place: node, begins, ends.

    One place may come several times (two anchors in one window), so different places are counted.
    """
    times = F.count_distinct("node", "begins").alias("times")
    shared = saved(left.groupBy("w1", "w2").agg(times).filter("times > 1").drop("times"), "shared-cores")
    single = left.join(shared, ["w1", "w2"]).select("w1", "w2", "node", "begins", "ends", F.posexplode("windows").alias("at", "window"))
    single = single.filter("window <> 0").select(
        "w1", "window", "node", (F.col("begins") - F.col("at")).alias("begins"), (F.col("ends") - F.col("at")).alias("ends")
    )
    single = saved(single.distinct(), "open-windows")
    twice = single.groupBy("w1", "window").agg(times).filter("times > 1").drop("times")
    return single.join(twice, ["w1", "window"], "left_semi").select("node", "begins", "ends")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """Each document without the bytes that a repeated string of `length` bytes covers.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with `texts` also spans (begin, end in
    bytes, flat) and kept (the remaining bytes). A string is repeated when it also starts anywhere else, in this or
    any other document; it is judged on the input, overlaps count, and it never crosses documents. A null text is
    empty; an empty or short one stays whole. Repeated rows are copies of each other. Columns other than doc_id and
    text are not read.
    """
    spans = repeated_spans(docs, length, gram).select(F.col("t1").alias("key1"), F.col("t2").alias("key2"), "pairs")
    spans = spans.hint("merge")
    whole = _whole(docs).withColumns({"t1": _text_keys(F.col("text"))[0], "t2": _text_keys(F.col("text"))[1]})
    joined = whole.join(spans, (F.col("t1") == F.col("key1")) & (F.col("t2") == F.col("key2")), "left")
    ddl = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["spans", "kept"] if texts else [])
    ddl += ", spans array<bigint>, kept binary" if texts else ""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                data, bounds = text_bytes(part.column(1))
                rows = []
                for row, pairs in enumerate(part.column(2).to_pylist()):
                    text = data[bounds[row]:bounds[row + 1]]
                    runs = _union(np.array(pairs, np.int64)) if pairs else np.zeros(0, np.int64)
                    edges = np.concatenate([[0], runs, [len(text)]])
                    kept = b"".join(text[a:b].tobytes() for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
                    rows.append((
                        len(text), len(text) - len(kept), len(runs) // 2, hashlib.sha256(kept).hexdigest(), runs.tolist(), kept,
                    ))
                columns = [pa.array(c, kind) for c, kind in list(zip(zip(*rows), kinds))[:len(names)]]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    id_type = dict(docs.dtypes)["doc_id"]
    return joined.select("doc_id", "text", "pairs").mapInArrow(cut, f"doc_id {id_type}, {ddl}")
