"""Operators on texts against brute force: Jaccard join, suffix-array dedup, decontamination, and the word numbers."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from odd import ODD
from mailtables.llm import decontaminate, jaccard, suffixes, words
from mailtables.llm.components import components

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("size", [16, 1 << 19])
def test_word_numbers(monkeypatch, size):
    monkeypatch.setattr(words, "SLICE", size)
    texts = ["One two", None, "", "two", "  ONE\ttwo-x", "é" * 40, "twoone", "a" * 100 + " two", "two"]
    for kind, pattern in ((words.SPACED, SPACED), (words.PLAIN, PLAIN)):
        numbers, bounds = words.words(pa.array(texts), kind)
        known = {}
        for row, text in enumerate(texts):
            own = numbers[bounds[row]:bounds[row + 1]].tolist()
            found = pattern.findall(lower(text))
            assert len(own) == len(found)
            for word, number in zip(found, own):
                assert known.setdefault(word, number) == number
        assert len(set(known.values())) == len(known)


def test_components(spark):
    numbers = random.Random(3)
    pairs = [(numbers.randrange(300), numbers.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    root = {x: x for p in pairs for x in p}
    for _ in range(500):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    assert got == {n: r for n, r in root.items() if n in got}
    assert {n for p in pairs if p[0] != p[1] for n in p} == set(got)
    assert components(frame.limit(0)).count() == 0


def brute_groups(rows, length, link):
    sets = []
    for _, text, _ in rows:
        found = SPACED.findall(lower(text))
        sets.append({tuple(found[i:i + length]) for i in range(max(1, len(found) - length + 1))} if found else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and link[1] * len(sets[i] & sets[j]) >= link[0] * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            groups.setdefault(top(i), []).append(doc_id)
    return Counter(
        (rows[i][0], len(sets[i]), min(groups.get(top(i), [None]) if sets[i] else [rows[i][0]], default=None)) for i in range(len(rows))
    )


def near_copies(seed, families, copies, size):
    numbers = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(families):
        base = numbers.choices(vocabulary, k=numbers.randrange(2, size))
        for _ in range(copies):
            text = list(base)
            for _ in range(numbers.randrange(0, 4)):
                text[numbers.randrange(len(text))] = numbers.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(text), "s"))
    numbers.shuffle(rows)
    return rows


@pytest.mark.parametrize("length, link", [(3, (90, 100)), (5, (80, 100))])
def test_jaccard_groups(docs, monkeypatch, length, link):
    rows = near_copies(length, 25, 12, 200) + [(10_000 + n, "boiler plate " * 3 + t, s) for n, (i, t, s) in enumerate(near_copies(9, 40, 1, 60))]
    got = Counter(tuple(r) for r in jaccard.link_groups(docs(rows), length, link).collect())
    assert got == brute_groups(rows, length, link)


def test_jaccard_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "_CHUNK", 20)
    rows = near_copies(4, 2, 150, 90)
    got = Counter(tuple(r) for r in jaccard.link_groups(docs(rows), 3, (90, 100)).collect())
    assert got == brute_groups(rows, 3, (90, 100))


def test_jaccard_odd_rows(docs):
    got = Counter(tuple(r) for r in jaccard.link_groups(docs(ODD), 3, (90, 100)).collect())
    assert got == brute_groups(ODD, 3, (90, 100))
    assert jaccard.link_groups(docs([])).count() == 0
    kept = jaccard.keep_first(docs(ODD))
    assert kept.columns == docs(ODD).columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 4, 6, 7, 9, 9]


def test_tree_loses_no_pair():
    numbers = np.random.default_rng(2)
    sets = []
    for _ in range(30):
        base = numbers.integers(0, 1 << 62, size=numbers.integers(5, 2000)).astype(np.uint64)
        for _ in range(6):
            sets.append(np.unique(np.where(numbers.random(len(base)) < 0.03, base + np.uint64(1), base)))
    points = jaccard.Points([jaccard._group_counts(s) for s in sets], np.array([len(s) for s in sets]))
    tree = jaccard.CountTree(points, (90, 100))
    i, j = tree.pairs_between(*tree.leaf_pairs())
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                assert frozenset((a, b)) in found


def brute_dedup(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    counts = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = Counter()
    for (doc_id, _, _), b in zip(rows, texts):
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1]))
        out[(doc_id, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages(seed):
    numbers = random.Random(seed)
    letters = "abcdé "
    shared = ["".join(numbers.choices(letters, k=numbers.randrange(20, 200))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = ["".join(numbers.choices(letters, k=numbers.randrange(0, 150)))]
        for _ in range(numbers.randrange(0, 3)):
            passage = numbers.choice(shared)
            cut = numbers.randrange(0, len(passage))
            parts += [passage[cut // 3:], "".join(numbers.choices(letters, k=numbers.randrange(0, 30)))]
        rows.append((i, "".join(parts), "s"))
    rows += [(500, "ab" * 200, "s"), (501, "x" * 130, "s"), (502, rows[5][1], "s"), (502, rows[5][1], "s"), (503, None, None), (None, "", "s")]
    return rows


@pytest.mark.parametrize("hot, tile", [(2000, 12_000), (5, 12_000), (5, 7)])
def test_suffix_dedup(docs, monkeypatch, hot, tile):
    monkeypatch.setattr(suffixes, "_HOT", hot)
    monkeypatch.setattr(suffixes, "_TILE", tile)
    rows = passages(tile)
    out = suffixes.dedup(docs(rows), length=50, gram=20).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == brute_dedup(rows, 50)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_a_lone_place_finds_windows_settled_in_another_part(spark, monkeypatch, seed):
    """Run in this process, as tasks do not see patched limits."""
    monkeypatch.setattr(suffixes, "_HOT", 5)
    monkeypatch.setattr(suffixes, "_TILE", 100)
    numbers = random.Random(seed)
    some = lambda k: "".join(numbers.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    passage, texts = some(45), []
    for copies in [3] * 100 + [1] * 100:
        ahead = numbers.randrange(0, 7)
        shared = some(ahead) + passage + some(6 - ahead)  # two windows, of three places each
        texts += [some(10) + shared + some(10) for _ in range(copies)]
    data, bounds = words.text_bytes(pa.array(texts))
    place, number = suffixes.anchors(data, bounds, 50, 40)
    node = np.searchsorted(bounds, place, "right") - 1
    members = Counter(number.tolist())
    assert max(members.values()) > 200
    own = [[] for _ in texts]
    for n, p, name in zip(node.tolist(), (place - bounds[node]).tolist(), number.view(np.int64).tolist()):
        own[n].append((name, [p], members[name % (1 << 64)]))
    columns = [texts, range(len(texts)), *([[x[k] for x in each] for each in own] for k in range(3))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["text", "node", "numbers", "places", "members"])
    around = pa.Table.from_batches(suffixes._contexts(iter([batch]), 50, 40))
    around = around.sort_by([("number", "ascending"), ("tile", "ascending")]).combine_chunks()
    matched = pa.Table.from_batches(suffixes._matched(iter(around.to_batches()), 50, 40)).to_pylist()
    left = spark.createDataFrame([tuple(r.values()) for r in matched if r["windows"]], suffixes._FOUND_DDL)
    found = [(r["node"], r["begins"], r["ends"]) for r in matched if not r["windows"]]
    found += map(tuple, suffixes._across_parts(left).collect())
    covered = [set() for _ in texts]
    for n, begins, ends in found:
        covered[n].update(range(begins, ends))
    times = Counter(t[i:i + 50] for t in texts for i in range(len(t) - 49))
    for text, got in zip(texts, covered):
        assert got == {j for i in range(len(text) - 49) if times[text[i:i + 50]] > 1 for j in range(i, i + 50)}


def test_suffix_dedup_odd_rows(docs):
    out = suffixes.dedup(docs(ODD), texts=False).collect()
    assert Counter(tuple(r) for r in out) == brute_dedup(ODD, 400)
    assert suffixes.dedup(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_arrays(seed):
    numbers = np.random.default_rng(seed)
    rows = numbers.integers(0, 2 + seed, size=(150, 12)).astype(np.uint8)
    lengths = numbers.integers(0, 13, size=150)
    rows[np.arange(12) >= lengths[:, None]] = 0
    group = np.sort(numbers.integers(0, 4, size=150))
    array = suffixes.SuffixArray(rows, lengths, group)
    texts = [(g, bytes(r[:n])) for g, r, n in zip(group.tolist(), rows, lengths.tolist())]
    assert [texts[i] for i in array.order] == sorted(texts)
    named = array.classes(5)
    for i in range(150):
        for j in range(i):
            if lengths[i] >= 5 and lengths[j] >= 5:
                assert (named[i] == named[j]) == (group[i] == group[j] and (rows[i, :5] == rows[j, :5]).all())


def test_suffix_arrays_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(suffixes, "_BYTES", np.ones(256, np.uint64))
    rows = np.random.default_rng(0).integers(0, 3, size=(60, 6)).astype(np.uint8)
    array = suffixes.SuffixArray(rows, np.full(60, 6), np.zeros(60, np.int64))
    assert [bytes(rows[i]) for i in array.order] == sorted(bytes(r) for r in rows)


def brute_found(rows, items, window, slop=None):
    runs = {}
    for item, text in items:
        found = PLAIN.findall(lower(text))
        n = min(window, len(found))
        if n:
            runs.setdefault(str(item) if item is not None else "", set()).update(tuple(found[i:i + n]) for i in range(len(found) - n + 1))
    out = Counter()
    for doc_id, text, _ in rows:
        found = PLAIN.findall(lower(text))
        hit, names, near = set(), set(), set()
        for item, own in runs.items():
            for run in own:
                for i in range(len(found) - len(run) + 1):
                    if tuple(found[i:i + len(run)]) == run:
                        hit.update(range(i, i + len(run)))
                        names.add(item)
                if slop is not None:
                    width = len(run) + slop
                    if any(set(run) <= set(found[max(0, i):i + width]) for i in range(-width + 1, len(found))):
                        near.add(item)
        out[(doc_id, len(found), len(hit), tuple(sorted(names)), tuple(sorted(near)))] += 1
    return out


def hits(pairs):
    return sum(b - a for a, b in zip(pairs[::2], pairs[1::2]))


@pytest.mark.parametrize("passes, slop", [(100_000, 2), (5, None), (5, 1)])
def test_decontamination(spark, docs, monkeypatch, passes, slop):
    monkeypatch.setattr(decontaminate, "WINDOWS_A_PASS", passes)
    numbers = random.Random(1)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(numbers.choices(vocabulary, k=numbers.randrange(0, 12)))) for i in range(12)] + [(None, "solo"), (99, None)]
    rows = []
    for i in range(60):
        text = numbers.choices(vocabulary, k=numbers.randrange(0, 60))
        for _ in range(numbers.randrange(0, 3)):
            text.insert(numbers.randrange(0, len(text) + 1), numbers.choice(items)[1] or "")
        rows.append((i, ", ".join(text).upper() if i % 5 == 0 else " ".join(text), "s"))
    rows += [(200, None, "s"), (201, "", "s"), (202, "Solo", "s"), (202, "Solo", "s"), (None, "solo solo", None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").crossJoin(spark.range(1))
    out = decontaminate.find(docs(rows), benchmark, window=4, slop=slop).collect()
    got = Counter((r["doc_id"], r["n_words"], hits(r["spans"]), tuple(r["items"]), tuple(r["near_items"])) for r in out)
    assert got == brute_found(rows, items, 4, slop)


def test_passes_agree_on_documents_read_in_another_order(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(decontaminate, "WINDOWS_A_PASS", 5)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(5))) for i in range(12)]
    rows = [(i, f"{'own ' * i}{items[i % 12][1]} {items[i % 7][1]}", "s") for i in range(40)]
    reads = str(tmp_path / "reads")

    def turned(batches):
        """Rows start elsewhere each time they are read, as shuffled rows may."""
        with open(reads, "a") as file:
            file.write("x")
            file.flush()
            start = file.tell()
        table = pa.Table.from_batches(batches)
        yield from table.take([(i + start) % len(table) for i in range(len(table))]).to_batches()

    moving = docs(rows).select("doc_id", "text").coalesce(1).mapInArrow(turned, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.find(moving, benchmark, window=4).collect()
    got = Counter((r["doc_id"], r["n_words"], hits(r["spans"]), tuple(r["items"]), ()) for r in out)
    assert got == brute_found(rows, items, 4)


def test_contaminated_rows_go(spark, docs):
    passage = " ".join(f"b{i}" for i in range(13))
    rows = [(1, passage, "s"), (2, "clean " * 300 + passage, "s"), (3, "clean", "s"), (None, None, None), (4, passage + " x" * 247, "s")]
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    kept = decontaminate.clean(docs(rows), benchmark)
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, None}
    judged = {r["doc_id"]: r for r in decontaminate.judged(decontaminate.find(docs(rows), benchmark)).collect()}
    assert judged[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert judged[3]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not judged[3]["contaminated"]
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean(docs(rows), empty).count() == 5
    assert decontaminate.find(docs([]), benchmark).count() == 0
