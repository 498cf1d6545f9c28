"""Conversation prefix trie: merges of sorted neighbours along their longest common prefixes, part by part.

Conversations are sorted by their turns over all partitions. In that order the members of any trie node are a run of
neighbours, and a node at depth d is a component of the neighbour links whose longest common prefix (LCP) is d or
more. Each sorted part is walked once with a stack, which merges neighbours in descending depth: every merge of two
runs opens a node, every pop closes one and folds its sums into its parent, so each part yields its own forest of
(partial) nodes in time linear in its turns. Forests are then merged across part boundaries by node key (a hash chain
of the prefix), with the LCP of each boundary telling which part closes a node that spans several: distinct-node sums
(children, leaves, bytes of last texts) are counted where the node closes, member sums everywhere.
"""

from __future__ import annotations

import struct

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailtables.llm.ranks import range_sorted
from mailtables.llm.stored import saved

#: Fixed values of the contract: the rebuilt conversation takes the first h turns of conversation c - c % FAMILY,
#: with h = crc32(decimal c) % HEAD_MOD.
FAMILY = 5
HEAD_MOD = 9

_PARTIAL = (
    "part long, depth long, k1 long, k2 long, p1 long, p2 long, least long, n_convs long, nb long, b_closed long, "
    "leaves long, children long, ends string"
)
_ROOT = (0, 0)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c) of every conversation id, and (c, j, role, text): its rebuilt turns, j from 0.

    Turns are ordered by turn (null first), then role and text; a null role or text is empty. Conversation c takes
    the first h turns of conversation c - c % 5 (all if fewer, none if it is absent), then its own turns from its
    (h+1)-th on. Rows without conv_id belong to no conversation and are left out. A parent lends its head to five
    conversations at most, so no join fans out further.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = saved(turns.withColumn("k", F.row_number().over(order) - 1).drop("turn"), "trie-turns")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    ids = lengths.select(
        F.col("conv_id").alias("c"), F.col("length").alias("own_length"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_MOD).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("p"),
    )
    ids = ids.join(lengths.select(F.col("conv_id").alias("p"), F.col("length").alias("p_length")), "p", "left")
    head = ids.join(turns.withColumnRenamed("conv_id", "p"), "p").filter(F.col("k") < F.col("h")).select(
        "c", F.col("k").alias("j"), "role", "text"
    )
    tail = ids.join(turns.withColumnRenamed("conv_id", "c"), "c").filter(F.col("k") >= F.col("h")).select(
        "c", (F.least("h", F.coalesce("p_length", F.lit(0))) + F.col("k") - F.col("h")).alias("j"), "role", "text"
    )
    return ids.select("c"), head.unionByName(tail)


def _turn_hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), "role", "text")


def sequences(conversations: DataFrame) -> DataFrame:
    """c, seq (turn hashes as (h1, h2) in order), bytes (UTF-8 bytes of each turn's text); turnless ones get []."""
    ids, turns = rebuilt(conversations)
    hashed = turns.select(
        "c", F.struct("j", _turn_hash("turn-1").alias("h1"), _turn_hash("turn-2").alias("h2"),
                      F.octet_length("text").cast("bigint").alias("b")).alias("t")
    )
    per = hashed.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    per = ids.join(per, "c", "left").select("c", F.coalesce("ts", F.array().cast(per.schema["ts"].dataType)).alias("ts"))
    return per.select(
        "c", F.transform("ts", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"))).alias("seq"),
        F.transform("ts", lambda t: t["b"]).alias("bytes"),
    )


def _key(parent: tuple[int, int], h1: int, h2: int) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(struct.pack("<qqqq", parent[0], parent[1], h1, h2))
    return struct.unpack("<qq", digest)


def _forest(boundaries: dict[int, int]):
    """The per-part walk: rows of one part in sorted order in, partial nodes out."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        part = int(rows["part"].iloc[0])
        out = []
        closing = boundaries.get(part, -1)  # nodes up to this depth go on into the next part

        def close(node, parent, last):
            closes = last is False or node["depth"] > closing
            node["nb"] += node["n"] * node["b"]
            if closes:
                node["b_closed"] += node["b"]
                if node["children"] == 0:
                    node["leaves"] += 1
            out.append((part, node["depth"], *node["key"], *node["pkey"], node["least"], node["n"], node["nb"],
                        node["b_closed"], node["leaves"], node["children"], ",".join(node["ends"])))
            if parent is not None:
                for name in ("nb", "b_closed", "leaves"):
                    parent[name] += node[name]
                parent["children"] += int(closes)
                parent["least"] = min(parent["least"], node["least"])

        def opened(depth, key, pkey, b):
            return {"depth": depth, "key": key, "pkey": pkey, "b": b, "n": 0, "nb": 0, "b_closed": 0, "leaves": 0,
                    "children": 0, "least": 1 << 63, "ends": []}

        stack: list[dict] = []
        previous = None
        for c, seq, sizes in zip(rows["c"], rows["seq"], rows["bytes"]):
            seq = [(int(t["h1"]), int(t["h2"])) for t in seq]
            if previous is None:
                lcp = -1
            else:
                lcp = 0
                while lcp < min(len(seq), len(previous)) and seq[lcp] == previous[lcp]:
                    lcp += 1
            while len(stack) > lcp + 1:
                node = stack.pop()
                close(node, stack[-1] if stack else None, False)
            if not stack:
                stack.append(opened(0, _ROOT, (0, 0), 0))
            for depth in range(len(stack), len(seq) + 1):
                parent = stack[-1]
                stack.append(opened(depth, _key(parent["key"], *seq[depth - 1]), parent["key"], int(sizes[depth - 1])))
            for node in stack:
                node["n"] += 1
            stack[-1]["least"] = min(stack[-1]["least"], int(c))
            stack[-1]["ends"].append(str(int(c)))
            previous = seq
        while stack:
            node = stack.pop()
            close(node, stack[-1] if stack else None, True)
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in _PARTIAL.split(", ")])
        frame.loc[frame["depth"] == 0, ["p1", "p2"]] = 0
        return frame

    return walk


def _lcp(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays, natively: the first place where they differ (or the shorter length)."""
    first_difference = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first_difference == 0, F.size(a)).otherwise(first_difference - 1)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per trie node.

    A node is a distinct sequence of the first d rebuilt turns (role, text); the root (d = 0) holds every conversation
    id, turnless ones too. conv_id is the node's smallest member; saved_tokens sums over the subtree, each node's
    (members - 1) times the UTF-8 bytes of its last text; ends_sha256 hashes the ascending ids of members with exactly d
    turns, comma-joined (the empty text's hash if none). Empty input: no nodes, not even a root. Only conv_id, turn,
    role and text are read.

    Turns are compared by two 64-bit hashes of (role, text), and nodes keyed by a 128-bit hash chain of them.
    The walk runs in Python per sorted part; the list of a node's ending ids is the one sum that is not split: its
    hash needs them in order.
    """
    placed = range_sorted(sequences(conversations), ["seq", "c"], "trie-sorted")
    edges = placed.groupBy("part").agg(F.min_by("seq", "row").alias("first"), F.max_by("seq", "row").alias("last"))
    ahead = Window.orderBy("part")
    edges = edges.select("part", "last", F.lead("first").over(ahead).alias("next_first"))
    boundaries = {
        int(r["part"]): int(r["lcp"])
        for r in edges.filter(F.col("next_first").isNotNull()).select("part", _lcp(F.col("last"), F.col("next_first")).alias("lcp")).collect()
    }
    partial = placed.select("part", "row", "c", "seq", "bytes").groupBy("part").applyInPandas(_forest(boundaries), _PARTIAL)
    partial = saved(partial, "trie-partial")
    ends = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ends") != "", F.struct("part", "ends")))),
                                    lambda e: e["ends"]), ",")
    nodes = partial.groupBy("depth", "k1", "k2").agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("least").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"),
        (F.sum("nb") - F.sum("b_closed")).alias("saved_tokens"), F.sha2(ends, 256).alias("ends_sha256"),
    )
    nodes = saved(nodes, "trie-nodes")
    parents = nodes.select(
        (F.col("depth") + 1).alias("child_depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    linked = nodes.join(
        parents, (F.col("depth") == F.col("child_depth")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")),
        "left",
    )
    return linked.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
