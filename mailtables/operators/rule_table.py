"""Account rules as a table: every rule word in Aho-Corasick automata, one scan of each text per automaton.

With a few rules, a `contains` per word is cheapest; with thousands, those expressions swell the plan and the
generated code, and every text is scanned once per word. Here the words of all accounts go into automata built on
each executor from word lists: a text is read once per automaton whatever the number of words, and the plan is the
same for ten rules or ten thousand. Accounts are dealt into automata of at most `AUTOMATON_BYTES` of words, all words
of one account in one, so each pass scores whole accounts; more rules mean more passes over the same rows, never a
larger broadcast. A pass adds the first account that reaches the threshold among its own and the partners it found;
the passes are then merged natively: the account of least config place, the partners in config order.

Rules whose accounts are rows of a table (`Rules.table`) never come to the driver: Spark keeps the first of the
accounts with the same words and the first mention of each partner, and writes them in runs of about `AUTOMATON_BYTES`
into the shared folder. A task reads one run at a time and holds at most one run and `HELD_BYTES` of messages; the
plan holds the folder's name only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mailtables.session import scratch_dir
from mailtables.sources.files import locate

#: Words of one automaton, in UTF-8 bytes; a larger rule set is scanned in more passes.
AUTOMATON_BYTES = 8 << 20
#: Messages a task holds while it reads the runs of a rule table one after the other; one run needs no holding.
HELD_BYTES = 64 << 20

_ALIAS, _KEYWORD, _DOMAIN = 0, 1, 2
_HIT = StructType([StructField("place", IntegerType()), StructField("name", StringType())])


def _words(rules) -> tuple[list[tuple[int, str, list[tuple[str, int]]]], list[str]]:
    """Accounts as (config place, name, [(lower-cased word, kind)]) and partner names in first-mention order."""
    accounts = []
    for place, account in enumerate(rules.accounts):
        words = [(w.lower(), _ALIAS) for w in account.aliases] + [(w.lower(), _KEYWORD) for w in account.keywords]
        words += [("@" + d.lower(), _DOMAIN) for d in account.domains]
        accounts.append((place, account.name, [(w, k) for w, k in words if w]))
    partners = list(dict.fromkeys(p for account in rules.accounts for p in account.partners))
    return accounts, partners


def _dealt(items: list, size) -> list[list]:
    """Items in runs of at most AUTOMATON_BYTES by `size` (an item larger than that is a run of its own)."""
    runs, run, used = [], [], 0
    for item in items:
        if run and used + size(item) > AUTOMATON_BYTES:
            runs.append(run)
            run, used = [], 0
        run.append(item)
        used += size(item)
    return runs + [run] if run else runs


def _boundary(text: str, start: int, end: int) -> bool:
    """Whole-word test: no letter, digit or underscore just before `start` or just after `end`."""
    def inner(i):
        return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")

    return not inner(start - 1) and not inner(end + 1)


def _automaton(words: dict[str, list[int]]):
    """An automaton over the words, and what stands behind each word, by the number the automaton reports for it."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, word in enumerate(words):
        automaton.add_word(word, (number, len(word)))
    if words:
        automaton.make_automaton()
    return automaton, [np.unique(np.array(entries, np.int64)) for entries in words.values()]


def _found(automaton, behind: list[np.ndarray], text: str | None, whole: bool) -> list[np.ndarray]:
    """What stands behind the words of a text, each word once however often it occurs."""
    if not text or not behind:
        return []
    if whole:
        hits = {number for end, (number, size) in automaton.iter(text) if _boundary(text, end - size + 1, end)}
    else:
        hits = {number for _, (number, _) in automaton.iter(text)}
    return [behind[number] for number in hits]


def _scorer(accounts: list[list[tuple[str, int]]], partners: list[str], match: str, weights: dict, threshold: int):
    """A function (text, addresses) -> (the first account that reaches the threshold or None, partners named), both by
    their place in the given lists. Accounts are lists of (word, kind), partners are names."""
    text_words, address_words = {}, {}
    for place, words in enumerate(accounts):
        for word, kind in words:
            target = address_words if kind == _DOMAIN else text_words
            target.setdefault(word, []).append(place * 3 + kind)
    first_partner = 3 * len(accounts)
    for place, name in enumerate(partners):
        text_words.setdefault(name.lower(), []).append(first_partner + place)
    texts, addresses = _automaton(text_words), _automaton(address_words)
    points = np.array([weights[kind] for kind in (_ALIAS, _KEYWORD, _DOMAIN)])
    marks = np.zeros((len(accounts), 3), bool)

    def score(text: str | None, address: str | None) -> tuple[int | None, list[int]]:
        # domains are looked for as `@domain` anywhere in the addresses, in both modes
        hits = _found(*texts, text, match == "word") + _found(*addresses, address, False)
        if not hits:
            return None, []
        entries = np.concatenate(hits)
        own = entries[entries < first_partner]
        marks.reshape(-1)[own] = True
        touched = own // 3
        reached = touched[marks[touched] @ points >= threshold]
        marks.reshape(-1)[own] = False
        named = np.unique(entries[entries >= first_partner]) - first_partner
        return int(reached.min()) if len(reached) else None, named.tolist()

    return score


def _pass(accounts, partners, match, weights, threshold):
    """The scan of one pass over Arrow batches: adds `_acct<n>` (place, name) and `_partners<n>`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer([words for _, _, words in accounts], partners, match, weights, threshold)
        for batch in batches:
            primary, named = [], []
            for text, address in zip(batch.column("_text").to_pylist(), batch.column("_addresses").to_pylist()):
                best, hits = score(text, address)
                primary.append(None if best is None else {"place": accounts[best][0], "name": accounts[best][1]})
                named.append([{"place": p, "name": partners[p]} for p in hits])
            yield batch.append_column("_acct", pa.array(primary, _ARROW_HIT)).append_column(
                "_partners_found", pa.array(named, pa.list_(_ARROW_HIT))
            )

    return scan


_ARROW_HIT = pa.struct([("place", pa.int32()), ("name", pa.string())])


def tag_by_table(staged: DataFrame, rules, match: str) -> tuple[DataFrame, Column, Column]:
    """`staged` (with `_text`, `_addresses`) after all passes, with the primary account and the partners as columns."""
    weights = {_ALIAS: rules.alias_weight, _KEYWORD: rules.keyword_weight, _DOMAIN: rules.domain_weight}
    if rules.table is not None:
        return _tag_by_runs(staged, rules.table, match, weights, rules.threshold)
    accounts, partners = _words(rules)
    account_runs = _dealt(accounts, lambda a: sum(len(w.encode()) + 16 for w, _ in a[2]) + 16)
    partner_runs = _dealt(partners, lambda p: len(p.encode()) + 16)
    passes = max(len(account_runs), len(partner_runs), 1)
    rows, firsts, found = staged, [], []
    for n in range(passes):
        run_accounts = account_runs[n] if n < len(account_runs) else []
        run_partners = partner_runs[n] if n < len(partner_runs) else []
        offset = sum(len(r) for r in partner_runs[:n])
        scan = _pass(run_accounts, run_partners, match, weights, rules.threshold)
        schema = StructType(rows.schema.fields + [
            StructField(f"_acct{n}", _HIT), StructField(f"_partners{n}", ArrayType(_HIT)),
        ])
        rows = rows.mapInArrow(_renamed(scan, n), schema)
        firsts.append(F.col(f"_acct{n}"))
        found.append(_shifted(f"_partners{n}", offset))
    primary = F.least(*firsts)["name"] if len(firsts) > 1 else firsts[0]["name"]
    partner_names = F.transform(F.array_sort(F.flatten(F.array(*found))), lambda h: h["name"])
    return rows, primary, partner_names


def _stored_rules(table: DataFrame) -> tuple[str, int]:
    """The folder and number of the runs of a rule table: rows (place, name, pos, partner, aliases, keywords, domains).

    Of accounts with the same words the first one wins wherever any of them does, so it stands for all; a partner is
    kept where it is first mentioned. Each row is dealt by a hash, so that a run has about `AUTOMATON_BYTES`. Accounts
    of one place go by name.
    """
    lists = ("aliases", "keywords", "domains")
    cleaned = [
        F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda w: w != "")))
        .alias(c) for c in lists
    ]
    order = F.struct("place", "name")
    accounts = table.select("place", "name", *cleaned).where(F.size(F.concat(*lists)) > 0)
    accounts = accounts.groupBy(*lists).agg(F.min(order).alias("first"))
    accounts = accounts.select("first.*", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("partner"), *lists)
    partners = table.select("place", "name", F.posexplode("partners").alias("pos", "partner")).where("partner <> ''")
    partners = partners.groupBy("partner").agg(F.min(F.struct("place", "name", "pos")).alias("first"))
    partners = partners.select("first.*", "partner", *[F.array().cast("array<string>").alias(c) for c in lists])

    spark, folder = table.sparkSession, scratch_dir(table.sparkSession, "rules")
    accounts.unionByName(partners).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    words = F.concat(*lists, F.array_compact(F.array("partner")))
    width = F.aggregate(words, F.lit(16).cast("bigint"), lambda size, w: size + F.octet_length(w) + 16)
    runs = max(1, math.ceil((rows.agg(F.sum(width)).first()[0] or 0) / AUTOMATON_BYTES))
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("partner", *lists), F.lit(runs)))
    dealt.repartition(min(runs, 10_000), "run").sortWithinPartitions("run").write.partitionBy("run").parquet(f"{folder}/runs")
    return f"{folder}/runs", runs


def _order(row: dict) -> tuple:
    """Config order as Spark sorts it: by place, then name, none before any; a partner by its position then."""
    return row["place"] is not None, row["place"], row["name"] is not None, row["name"], row["pos"] or 0, row["partner"] or ""


def _run_scorer(folder: str, run: int, match: str, weights: dict, threshold: int):
    """The scorer of one stored run, with (config order, name) of the accounts and of the partners it counts."""
    filesystem, base = locate(f"{folder}/run={run}")
    rows = []
    if filesystem.get_file_info(base).type == fs.FileType.Directory:
        for info in filesystem.get_file_info(fs.FileSelector(base)):
            if info.path.endswith(".parquet"):
                with filesystem.open_input_file(info.path) as file:
                    rows += pq.ParquetFile(file).read().to_pylist()
    rows.sort(key=_order)
    accounts, partners = ([r for r in rows if (r["partner"] is None) is own] for own in (True, False))
    words = [
        [(w.lower(), _ALIAS) for w in r["aliases"]] + [(w.lower(), _KEYWORD) for w in r["keywords"]]
        + [("@" + d.lower(), _DOMAIN) for d in r["domains"]] for r in accounts
    ]
    score = _scorer(words, [r["partner"] for r in partners], match, weights, threshold)
    return score, [(_order(r), r["name"]) for r in accounts], [(_order(r), r["partner"]) for r in partners]


def _tag_by_runs(
    staged: DataFrame, table: DataFrame, match: str, weights: dict, threshold: int
) -> tuple[DataFrame, Column, Column]:
    """`tag_by_table` for rules that are rows of a table: every task scores its messages by each stored run."""
    folder, runs = _stored_rules(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scorer(run):
            return _run_scorer(folder, run, match, weights, threshold)

        only, held, size = None, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if runs == 1:
                only = only or scorer(0)
                yield from _scored(held, [only])
            elif size >= HELD_BYTES:
                yield from _scored(held, map(scorer, range(runs)))
            else:
                continue
            held, size = [], 0
        if held:
            yield from _scored(held, map(scorer, range(runs)))

    schema = StructType(staged.schema.fields + [
        StructField("_acct0", StringType()), StructField("_partners0", ArrayType(StringType())),
    ])
    return staged.mapInArrow(scan, schema), F.col("_acct0"), F.col("_partners0")


def _scored(batches: list[pa.RecordBatch], scorers: Iterable) -> Iterator[pa.RecordBatch]:
    """Batches with the first account and the partners over all runs, of which one is in memory at a time."""
    firsts = [[None] * batch.num_rows for batch in batches]
    named = [[[] for _ in range(batch.num_rows)] for batch in batches]
    for score, accounts, partners in scorers:
        for batch, first, found in zip(batches, firsts, named):
            for i, text in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_addresses").to_pylist())):
                best, hits = score(*text)
                if best is not None and (first[i] is None or accounts[best] < first[i]):
                    first[i] = accounts[best]
                found[i] += [partners[hit] for hit in hits]
    for batch, first, found in zip(batches, firsts, named):
        primary = pa.array([f and f[1] for f in first], pa.string())
        partner_names = pa.array([[name for _, name in sorted(f)] for f in found], pa.list_(pa.string()))
        yield batch.append_column("_acct0", primary).append_column("_partners0", partner_names)


def _shifted(column: str, offset: int) -> Column:
    """Partner hits of one pass with their places counted over all passes."""
    return F.transform(column, lambda h: F.struct((h["place"] + F.lit(offset)).alias("place"), h["name"].alias("name")))


def _renamed(scan, n: int):
    """The scan with its two added columns named for pass `n`."""

    def run(batches):
        for batch in scan(batches):
            names = batch.schema.names[:-2] + [f"_acct{n}", f"_partners{n}"]
            yield batch.rename_columns(names)

    return run


def pass_columns(rows: DataFrame) -> list[str]:
    """The columns the passes added, to be dropped once merged."""
    return [c for c in rows.columns if c.startswith("_acct") or c.startswith("_partners") and c[9:].isdigit()]
