"""N-gram Jaccard join: sets of word shingles as points of group counts in R-trees, surviving pairs verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.llm.components import components
from mailtables.llm.stored import lookup, saved
from mailtables.llm.words import SPACED, lists, mixed, numbered, pieces, words

WORDS = 5
#: Two sets link when LINK[1] * intersection >= LINK[0] * union.
LINK = (80, 100)
#: Groups of a point; sets of `FINE_FROM` shingles or more have a finer point besides, as chance evens out large counts.
GROUPS, FINE_GROUPS, FINE_FROM = 64, 512, 1000
_LEAF, _FAN_OUT = 32, 8
_HEAT_BITS = 16
#: Members of a block or group in one task; larger ones are dealt into chunks, and every two chunks meet in a task.
_CHUNK = 1000
_CHUNK_SHINGLES = 1_000_000
_PAIRS_AT_ONCE = 1 << 17


def shingle_sets(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    """Each row's different shingles as sorted 64-bit numbers: runs of `length` words, or all its words if fewer."""
    numbers, bounds = words(column, SPACED)
    factors = numbered(length + 1, 2)
    total = max(0, len(numbers) - length + 1)
    runs = np.zeros(total, np.uint64)
    for step in range(length):
        runs += mixed(numbers[step:step + total] + factors[step]) * factors[step]
    runs = mixed(runs)
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if stop - start >= length:
            yield np.unique(runs[start:stop - length + 1])
        elif stop > start:
            few = mixed(numbers[start:stop] + factors[:stop - start]) * factors[:stop - start]
            yield mixed(few.sum(dtype=np.uint64, keepdims=True) + factors[length:] * np.uint64(stop - start))
        else:
            yield np.zeros(0, np.uint64)


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    first, second = mixed(shingles ^ np.uint64(0xA5A5A5A5)), mixed(shingles + np.uint64(0x5EED))
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (first, second))


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles + np.uint64(77)) >> np.uint64(64 - _HEAT_BITS)).astype(np.int64)


def shingle_heat(docs: DataFrame, length: int) -> np.ndarray:
    """How common shingles are, over all documents: a level for each of 2^16 buckets of shingles, 0 for the usual.

    A shingle that a noticeable part of all documents share lifts its bucket above the mean, at any corpus size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _HEAT_BITS, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                for shingles in shingle_sets(part.column(0), length):
                    np.add.at(counts, _bucket(shingles), 1)
        buckets = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts[buckets])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(counted, "bucket bigint, n bigint")
    counts = np.zeros(1 << _HEAT_BITS)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 2^16 rows at most
        counts[row["bucket"]] = row["n"]
    return np.log2(np.maximum(1, counts / max(1e-9, counts.mean()))).astype(np.uint8)


def _group_counts(shingles: np.ndarray) -> bytes:
    """Shingles counted by group, up to 255 a group: `GROUPS` bytes, and `FINE_GROUPS` more for a large set."""
    scrambled = mixed(shingles + np.uint64(99))
    counts = np.minimum(np.bincount((scrambled >> np.uint64(58)).astype(np.int64), minlength=GROUPS), 255)
    if len(shingles) < FINE_FROM:
        return counts.astype(np.uint8).tobytes()
    fine = np.minimum(np.bincount((scrambled >> np.uint64(55)).astype(np.int64), minlength=FINE_GROUPS), 255)
    return np.concatenate([counts, fine]).astype(np.uint8).tobytes()


class Points:
    """Sets as points of group counts. What lies beyond 255 in a group is the size less the sum of the counts."""

    def __init__(self, data: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        self.counts = np.frombuffer(b"".join(d[:GROUPS] for d in data), np.uint8).reshape(-1, GROUPS)
        self.beyond = sizes - self.counts.sum(axis=1, dtype=np.int64)
        large = [d[GROUPS:] for d in data if len(d) > GROUPS]
        self.fine = np.frombuffer(b"".join(large), np.uint8).reshape(-1, FINE_GROUPS)
        self.fine_row = np.cumsum(np.array([len(d) > GROUPS for d in data], np.int64)) - 1
        self.fine_row[np.array([len(d) == GROUPS for d in data], bool)] = -1

    def __len__(self) -> int:
        return len(self.sizes)

    def part(self, start: int, stop: int) -> Points:
        some = Points.__new__(Points)
        some.sizes, some.counts, some.beyond = self.sizes[start:stop], self.counts[start:stop], self.beyond[start:stop]
        some.fine, some.fine_row = self.fine, self.fine_row[start:stop]
        return some

    def may_link(self, i: np.ndarray, j: np.ndarray, link: tuple[int, int]) -> np.ndarray:
        """Whether the summed minima of the points' counts leave room for a link; finer counts are looked at last."""
        num, den = link
        needed = num * (self.sizes[i] + self.sizes[j])
        overlap = np.minimum(self.counts[i], self.counts[j]).sum(axis=1, dtype=np.int64)
        near = (overlap + np.minimum(self.beyond[i], self.beyond[j])) * (num + den) >= needed
        both = np.flatnonzero(near & (self.fine_row[i] >= 0) & (self.fine_row[j] >= 0))
        for at in range(0, len(both), _PAIRS_AT_ONCE // 8):
            some = both[at:at + _PAIRS_AT_ONCE // 8]
            a, b = self.fine[self.fine_row[i[some]]], self.fine[self.fine_row[j[some]]]
            overlap = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            beyond = np.minimum(
                self.sizes[i[some]] - a.sum(axis=1, dtype=np.int64), self.sizes[j[some]] - b.sum(axis=1, dtype=np.int64)
            )
            near[some] = (overlap + beyond) * (num + den) >= needed[some]
        return near


_SET_DDL = "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>, groups binary"


def described(docs: DataFrame, length: int, link: tuple[int, int], heat: np.ndarray) -> DataFrame:
    """Per document: the size and signature of its set, its block keys and its point.

    Block keys are the set's first shingles in one order that all sets share, commonest last: as many as two linking
    sets cannot both lack (size - least intersection + 1). So linking sets always have a block in common.
    """
    num, den = link
    levels = docs.sparkSession.sparkContext.broadcast(heat)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                rows, keys = [], []
                for shingles in shingle_sets(part.column(1), length):
                    first, second = _signature(shingles)
                    n = len(shingles)
                    prefix = n - -(-n * num // den) + 1 if n else 0
                    keys.append(shingles[np.lexsort((shingles, levels.value[_bucket(shingles)]))[:prefix]])
                    rows.append((n, first, second, _group_counts(shingles)))
                n, s1, s2, points = zip(*rows)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                    lists(np.concatenate(keys).view(np.int64), ends), pa.array(points, pa.binary()),
                ], ["doc_id", "n", "s1", "s2", "keys", "groups"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(describe, _SET_DDL)


class CountTree:
    """An R-tree of group counts, loaded in bulk: points are halved along their widest coordinate down to leaves."""

    def __init__(self, points: Points, link: tuple[int, int]):
        self.points, self.link = points, link
        self.leaves: list[np.ndarray] = []
        self._load(np.arange(len(points)))
        self.levels = [[np.array([i]) for i in range(len(self.leaves))]]
        while len(self.levels[-1]) > 1:
            below = len(self.levels[-1])
            self.levels.append([np.arange(i, min(i + _FAN_OUT, below)) for i in range(0, below, _FAN_OUT)])
        high = np.array([points.counts[leaf].max(axis=0) for leaf in self.leaves], np.uint8)
        more = np.array([points.beyond[leaf].max() for leaf in self.leaves])
        least = np.array([points.sizes[leaf].min() for leaf in self.leaves])
        most = np.array([points.sizes[leaf].max() for leaf in self.leaves])
        self.boxes = [(high, more, least, most)]
        for level in self.levels[1:]:
            high, more, least, most = self.boxes[-1]
            self.boxes.append((
                np.array([high[c].max(axis=0) for c in level], np.uint8), np.array([more[c].max() for c in level]),
                np.array([least[c].min() for c in level]), np.array([most[c].max() for c in level]),
            ))

    def _load(self, members: np.ndarray) -> None:
        if len(members) <= _LEAF:
            self.leaves.append(members)
            return
        some = self.points.counts[members]
        widest = int(np.argmax(some.max(axis=0).astype(int) - some.min(axis=0)))
        halves = np.argpartition(some[:, widest], len(members) // 2)
        self._load(members[halves[:len(members) // 2]])
        self._load(members[halves[len(members) // 2:]])

    def leaf_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (a <= b) that may hold a linking pair: the boxes' summed coordinate minima are enough."""
        num, den = self.link
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, more, least, most = self.boxes[depth]
            kept = []
            for at in range(0, len(a), _PAIRS_AT_ONCE):
                x, y = a[at:at + _PAIRS_AT_ONCE], b[at:at + _PAIRS_AT_ONCE]
                overlap = np.minimum(high[x], high[y]).sum(axis=1, dtype=np.int64) + np.minimum(more[x], more[y])
                floor = np.maximum(least[x], least[y])
                near = (den * overlap >= num * floor) & (den * most[x] >= num * least[y]) & (den * most[y] >= num * least[x])
                kept.append(np.stack([x[near], y[near]]))
            a, b = np.concatenate(kept, axis=1)
            if depth:
                children = self.levels[depth]
                grid = [np.stack(np.meshgrid(children[x], children[y], indexing="ij")).reshape(2, -1) for x, y in zip(a, b)]
                a, b = np.concatenate(grid, axis=1) if grid else np.zeros((2, 0), np.int64)
                ordered = a <= b
                a, b = a[ordered], b[ordered]
        order = np.argsort(b - a, kind="stable")  # neighbours first: they link most, and spare later pairs
        return a[order], b[order]

    def pairs_between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points of the given leaf pairs whose summed minima allow a link."""
        left, right = [], []
        for x, y in zip(a.tolist(), b.tolist()):
            one, two = self.leaves[x], self.leaves[y]
            if x == y:
                i, j = np.triu_indices(len(one), 1)
                left.append(one[i])
                right.append(one[j])
            else:
                left.append(np.repeat(one, len(two)))
                right.append(np.tile(two, len(one)))
        i, j = np.concatenate(left), np.concatenate(right)
        near = self.points.may_link(i, j, self.link)
        return i[near], j[near]


class Forest:
    """Which of `count` points are known to be linked, and the links that were needed to know it."""

    def __init__(self, count: int):
        self.root = np.arange(count)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.root[i] != self.root[j]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            high, low = np.maximum(self.root[i], self.root[j]), np.minimum(self.root[i], self.root[j])
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], np.diff(high[order]) != 0])] if len(order) else order
            self.links.append((i[first], j[first]))
            self.root[high[first]] = low[first]
            while not np.array_equal(self.root, jumped := self.root[self.root]):
                self.root = jumped
            still = self.apart(i, j)
            i, j = i[still], j[still]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in self.links]), np.concatenate([x[1] for x in self.links])


def join_block(points: Points, link: tuple[int, int], verify=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that the tree lets through and `verify(i, j)` confirms (all, without it).

    Pairs of points already connected are left out: they cannot change a component.
    """
    forest = Forest(len(points))
    if len(points) <= _LEAF:
        i, j = np.triu_indices(len(points), 1)
        near = points.may_link(i, j, link)
        _confirm(forest, i[near], j[near], verify)
        return forest.edges()
    tree = CountTree(points, link)
    a, b = tree.leaf_pairs()
    step = max(1, _PAIRS_AT_ONCE // _LEAF**2)
    while len(a):
        low = np.array([forest.root[leaf].min() for leaf in tree.leaves])
        high = np.array([forest.root[leaf].max() for leaf in tree.leaves])
        open_pairs = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        a, b = a[open_pairs], b[open_pairs]
        if len(a):
            i, j = tree.pairs_between(a[:step], b[:step])
            apart = forest.apart(i, j)
            _confirm(forest, i[apart], j[apart], verify)
        a, b = a[step:], b[step:]
    return forest.edges()


def _confirm(forest: Forest, i: np.ndarray, j: np.ndarray, verify) -> None:
    if verify is None:
        forest.link(i, j)
        return
    while len(i):
        some = verify(i[:256], j[:256])
        forest.link(i[:256][some], j[:256][some])
        i, j = i[256:], j[256:]
        apart = forest.apart(i, j)
        i, j = i[apart], j[apart]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first `keys` columns, as tables; a run may span batches.

    Runs that end within a batch come together in one table.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [np.asarray(batch.column(k)) for k in range(keys)]
        last = np.ones(batch.num_rows, bool)
        for value in values:
            last &= value == value[-1]
        start = int(np.argmax(last))  # the last run of the batch may go on in the next one
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks()
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(table: pa.Table, keys: int) -> np.ndarray:
    """Where the runs of a table begin, and its end."""
    begins = np.zeros(table.num_rows, bool)
    begins[0] = True
    for k in range(keys):
        value = table.column(k).to_numpy()
        begins[1:] |= value[1:] != value[:-1]
    return np.append(np.flatnonzero(begins), table.num_rows)


def _edges_batch(nodes: np.ndarray, edges) -> pa.RecordBatch:
    a, b = (np.concatenate([e[side] for e in edges]) if edges else np.zeros(0, np.int64) for side in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])


def _block_candidates(batches: Iterator[pa.RecordBatch], link: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows key, tile, node, n, groups sorted by key and tile: a forest of each block's surviving pairs."""
    for table in _runs(batches, 2):
        cuts = _cuts(table, 2)
        nodes = table.column("node").to_numpy()
        points = Points(table.column("groups").to_pylist(), table.column("n").to_numpy())
        edges = []
        width = np.diff(cuts)
        twos = cuts[:-1][width == 2]
        for at in range(0, len(twos), _PAIRS_AT_ONCE):
            i = twos[at:at + _PAIRS_AT_ONCE]
            near = points.may_link(i, i + 1, link)
            edges.append((i[near], i[near] + 1))
        for start, stop in zip(cuts[:-1][width > 2].tolist(), cuts[1:][width > 2].tolist()):
            a, b = join_block(points.part(start, stop), link)
            edges.append((a + start, b + start))
        yield _edges_batch(nodes, edges)


def _verified(batches: Iterator[pa.RecordBatch], link: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows root, tile, node, shingles sorted by root and tile: a forest of each group's links."""
    num, den = link
    for table in _runs(batches, 2):
        cuts = _cuts(table, 2)
        nodes, edges = table.column("node").to_numpy(), []
        texts = table.column("shingles").to_pylist()
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sets = [np.frombuffer(data, np.uint64) for data in texts[start:stop]]
            points = Points([_group_counts(s) for s in sets], np.array([len(s) for s in sets], np.int64))

            def verify(i, j, sets=sets):
                both = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())]
                either = [len(sets[x]) + len(sets[y]) - n for x, y, n in zip(i.tolist(), j.tolist(), both)]
                return den * np.array(both, np.int64) >= num * np.array(either, np.int64)

            a, b = join_block(points, link, verify)
            edges.append((a + start, b + start))
        yield _edges_batch(nodes, edges)


def _tiles(node: Column, chunks: Column) -> Column:
    """The tiles a member of a block of `chunks` chunks goes to: every two chunks share one."""
    own = F.pmod(F.xxhash64(node), chunks)
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), chunks - 1), lambda x: (x != own) | (chunks == 1))
    return F.transform(others, lambda x: F.least(own, x) * chunks + F.greatest(own, x))


def link_groups(docs: DataFrame, length: int = WORDS, link: tuple[int, int] = LINK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    A document's set: its different runs of `length` words (A-Z lower-cased; words are runs of anything but space and
    the control characters 9 to 13), or all its words as one if they are fewer. Two link when their sets' Jaccard
    similarity is link[0] / link[1] or more. Null and empty texts have an empty set, no links and their own id.
    Repeated rows are rows; a row without doc_id gets the component of its text, or null. Columns other than doc_id
    (bigint) and text are not read. Shingles are compared by 64-bit numbers, whole sets by 128 bits.

    1. Documents of equal sets form classes; a class goes on as one node, so copies cost nothing from here on.
    2. Nodes meet in blocks, by shingles of their own, the commonest last, that linking sets cannot but share.
    3. Each block is an R-tree of group counts; pairs whose summed coordinate minima are too few are out. Blocks of
       the same members are searched once. A block hands on a forest of its pairs, never all of them.
    4. What the forests connect is verified on whole sets, again through a tree, pair by pair until connected.
    5. Components of the verified links give the ids.

    A block or group of more than `_CHUNK` members is dealt into chunks, every two of which meet in a task.
    """
    narrow = docs.select("doc_id", "text")
    sets = saved(described(narrow, length, link, shingle_heat(narrow, length)), "shingle-sets")
    point = F.struct("keys", "groups")
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min_by(point, "doc_id").alias("point")
    )
    classes = saved(classes.select("*", "point.*").drop("point").withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = saved(_candidates(classes, link), "candidates")
    groups = saved(components(edges), "candidate-groups")
    links = saved(_links(narrow, classes, groups, length, link), "links")
    linked = components(links).join(classes.select("node", "first_id"), "node")
    names = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = linked.select("node", "root").join(names, "root").select("node", "component_id")
    found = classes.select("node", "n", "s1", "s2", "first_id", "copies").join(labels, "node", "left")
    found = found.filter("copies > 1 OR component_id IS NOT NULL").select(
        "n", "s1", "s2", F.coalesce("component_id", "first_id").alias("component_id")
    )
    found = saved(found, "components")
    return sets.select("doc_id", "n", "s1", "s2").join(lookup(found), ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _candidates(classes: DataFrame, link: tuple[int, int]) -> DataFrame:
    keys = classes.select("node", F.explode("keys").alias("key"))
    blocks = keys.groupBy("key").agg(
        F.count("*").alias("members"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("sign"),
    ).filter("members > 1")
    blocks = saved(blocks.groupBy("members", "low", "high", "sign").agg(F.min("key").alias("key")), "blocks")
    pairs = blocks.filter("members = 2").select("key", F.lit(2).cast("bigint").alias("members"), F.explode(F.array("low", "high")).alias("node"))
    more = keys.join(lookup(blocks.filter("members > 2").select("key", "members")), "key").select("key", "members", "node")
    points = classes.select("node", "n", "groups")
    rows = pairs.unionByName(more).join(points, "node")
    chunks = F.ceil(F.col("members") / _CHUNK)
    rows = rows.select("key", F.explode(_tiles(F.col("node"), chunks)).alias("tile"), "node", "n", "groups")
    rows = rows.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return rows.mapInArrow(lambda batches: _block_candidates(batches, link), "a bigint, b bigint")


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, length: int, link: tuple[int, int]) -> DataFrame:
    wanted = groups.join(classes.select("node", "first_id", "n", "s1"), "node")
    sizes = wanted.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / _CHUNK), F.ceil(F.sum("n") / _CHUNK_SHINGLES)).alias("chunks")
    )
    wanted = saved(wanted.join(sizes, "root").drop("n"), "wanted")
    texts = docs.join(lookup(wanted), F.col("doc_id") == F.col("first_id")).select("root", "chunks", "node", "s1", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 4):
                sets = list(shingle_sets(part.column(4), length))
                own = [i for i, s1 in enumerate(part.column(3).to_pylist()) if _signature(sets[i])[0] == s1]
                kept = part.take(pa.array(own, pa.int64()))
                data = pa.array([sets[i].tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], data], ["root", "chunks", "node", "shingles"])

    rows = texts.mapInArrow(shingled, "root bigint, chunks bigint, node bigint, shingles binary")
    rows = rows.select("root", F.explode(_tiles(F.col("node"), F.col("chunks"))).alias("tile"), "node", "shingles")
    rows = rows.repartition("root", "tile").sortWithinPartitions("root", "tile")
    return rows.mapInArrow(lambda batches: _verified(batches, link), "a bigint, b bigint")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """`docs` without near copies: of each component the smallest doc_id stays.

    Rows without words, or without doc_id, stay. Rows that repeat a doc_id stay or go together.
    """
    found = link_groups(docs, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias("copy")).distinct()
    found = saved(found, "near-copies")
    return docs.join(found, docs["doc_id"] == found["copy"], "left_anti")
