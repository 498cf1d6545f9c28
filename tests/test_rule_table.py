"""Rules as a table: automata give the rows of the expressions, over many passes too, and the plan does not grow."""

import random

import pytest
from pyspark.sql import functions as F

from mailtables.operators import rule_table, tagging
from mailtables.operators.tagging import Account, Rules, tag_accounts
from test_tagging import CASES, RULES, SCHEMA, tag


def _rows(result):
    return sorted((r["message_id"], r["account_tag"], tuple(r["partner_tags"])) for r in result.collect())


@pytest.mark.parametrize("match", ["substring", "word"])
@pytest.mark.parametrize("bound", [8 << 20, 40])
def test_same_rows_as_expressions(spark, monkeypatch, match, bound):
    monkeypatch.setattr(rule_table, "AUTOMATON_BYTES", bound)
    rows = [case[0] for case in CASES]
    words = ["acme", "rfp", "Globex", "umbrella", "x", "é", "naïve", "", None]
    rng = random.Random(5)
    rows += [(None, ["a@acme.com"], None, [], rng.choice(words[:-1]), " ".join(rng.choice(words[:-1]) for _ in range(9)))
             for _ in range(60)]
    rows += [(None, None, None, None, None, None), ("x@y", [], [], [], "", "z" * 100_000 + " acme rfp")]
    want = _rows(tag(spark, rows, RULES, match=match, method="expressions"))
    assert _rows(tag(spark, rows, RULES, match=match, method="table")) == want


def test_plan_does_not_grow_with_rules(spark):
    def rules(n):
        return Rules(accounts=tuple(
            Account(f"A{i}", (f"alias{i}",), (f"d{i}.example",), (f"P{i % 50}",), (f"kw{i}",)) for i in range(n)
        ))

    df = spark.createDataFrame([(1, "s@d7.example", [], [], [], "alias7", "kw7 p3")], SCHEMA)
    small, large = tag_accounts(df, rules(30), method="table"), tag_accounts(df, rules(5000), method="table")
    assert len(small._jdf.queryExecution().optimizedPlan().toString()) == len(
        large._jdf.queryExecution().optimizedPlan().toString()
    )
    row = large.first()
    assert (row["account_tag"], row["partner_tags"]) == ("A7", ["P3"])
    assert tag_accounts(df, rules(5000)).first()["account_tag"] == "A7"  # auto takes the table


def test_rules_from_table(spark, monkeypatch):
    table = spark.createDataFrame(
        [(2, "B", ["bee"], None, ["Ay"], []), (1, "A", ["ay", ""], ["a.example"], None, ["kw"])],
        "place int, name string, aliases array<string>, domains array<string>, partners array<string>, "
        "keywords array<string>",
    )
    rules = tagging.rules_from_table(table)
    assert rules.accounts == (Account("A", ("ay",), ("a.example",), (), ("kw",)), Account("B", ("bee",), (), ("Ay",), ()))
    monkeypatch.setattr(tagging, "TABLE_ROWS", 1)
    with pytest.raises(ValueError):
        tagging.rules_from_table(table)
    empty = tagging.rules_from_table(table.filter(F.lit(False)))
    assert empty.accounts == ()


RULE_DDL = (
    "place bigint, name string, aliases array<string>, domains array<string>, partners array<string>, keywords array<string>"
)


@pytest.mark.parametrize("match", ["substring", "word"])
@pytest.mark.parametrize("bound, held", [(8 << 20, 64 << 20), (60, 64 << 20), (60, 200)])
def test_accounts_of_a_table_give_the_rows_of_listed_ones(spark, monkeypatch, match, bound, held):
    monkeypatch.setattr(rule_table, "AUTOMATON_BYTES", bound)
    monkeypatch.setattr(rule_table, "HELD_BYTES", held)
    rng = random.Random(7)
    words = ["acme", "rfp", "Globex", "umbrella", "x", "\u00e9", "na\u00efve", "", None]
    pick = lambda: [rng.choice(words) for _ in range(rng.randrange(3))]
    accounts = [
        (place, f"A{place}", pick() or None, rng.choice([[], None, ["acme.com"], ["D7.example", ""]]), pick(), pick())
        for place in rng.sample(range(100), 12)
    ] + [(None, "none", ["umbrella"], [], ["Globex"], ["rfp"]), (200, None, ["x"], [], [], ["acme"])]
    accounts += [accounts[3], accounts[3]]  # repeated rows
    table = spark.createDataFrame(accounts, RULE_DDL)
    rows = [(None, [rng.choice(["a@acme.com", "b@d7.example", ""])], None, [], rng.choice(words),
             " ".join(rng.choice(words[:-1]) for _ in range(rng.randrange(6)))) for _ in range(80)]
    rows.append((None, None, None, None, None, None))
    for threshold in (2, 3):
        want = _rows(tag(spark, rows, tagging.rules_from_table(table, threshold=threshold), match=match, method="expressions"))
        got = _rows(tag(spark, rows, tagging.table_rules(table, threshold=threshold), match=match))
        assert got == want


def test_accounts_of_a_table_stay_off_the_driver(spark, monkeypatch):
    collect = type(spark.range(1)).collect

    def collected(rows):
        found = collect(rows)
        assert len(found) <= 1, "rules were read into the driver"
        return found

    table = spark.range(3000).selectExpr(
        "id AS place", "'A' || id AS name", "array('alias' || id) AS aliases", "array('d' || id || '.example') AS domains",
        "array('P' || id % 50) AS partners", "array('kw' || id) AS keywords",
    )
    df = spark.createDataFrame([(1, "s@d7.example", [], [], [], "alias7", "kw7 p3")], SCHEMA)
    monkeypatch.setattr(type(df), "collect", collected)
    rules = tagging.table_rules(table)
    tagged = tag_accounts(df, rules)
    monkeypatch.undo()
    row = tagged.first()
    assert (row["account_tag"], row["partner_tags"]) == ("A7", ["P3"])
    with pytest.raises(ValueError):
        tag_accounts(df, rules, method="expressions")
