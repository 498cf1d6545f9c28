"""Conversation prefix trie against a brute force over all prefixes, also with nodes split over many sorted parts."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from mailtables.llm import prefix_trie


def brute(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    ordered = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in ordered:
        h = zlib.crc32(str(c).encode()) % 9
        p = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        head = ordered.get(p, [])[:h]
        paths[c] = tuple(head + ordered[c][h:])
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = defaultdict(int)
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]] += 1
    out = []
    for prefix, members in nodes.items():
        d = len(prefix)
        subtree = [q for q in nodes if q[:d] == prefix]
        leaves = sum(children[q] == 0 for q in subtree)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in subtree if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == d))
        parent = min(nodes[prefix[:-1]]) if d else None
        out.append((min(members), d, parent, len(members), children[prefix], leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=None):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "'x' AS depth", "1 AS seq", "2 AS c"
    )
    if parts:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return sorted((tuple(r) for r in prefix_trie.trie(frame).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def fixture():
    rows = []
    for c in range(-12, 300):
        n = (c * 7) % 6
        for k in range(n):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", f"turn {k % 3} of {c % 4}"))
    for c in range(1000, 1400):  # one conversation repeated many times, so its nodes span parts
        rows += [(c, 0, "user", "hello"), (c, 1, "assistant", "é" * 30)]
    rows += [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", None), (8, 3, "user", "x" * 10_000),
             (9, 1, "user", "same"), (9, 1, "user", "same"), (2 ** 62, 0, "", ""), (-(2 ** 62), 0, "a", "b")]
    return rows


@pytest.mark.parametrize("parts", [None, 37])
def test_against_brute_force(spark, parts):
    rows = fixture()
    assert run(spark, rows, parts) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, None, None, None)]) == brute([(4, None, None, None)])
