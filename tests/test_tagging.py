import re

import yaml
import pytest
import samples as S
from mailtables.functions.patterns import to_java
from mailtables.operators.tagging import Account, Rules, load_config, rules_from_config, tag_accounts, tag_rows

SCHEMA = (
    "message_id bigint, sender_email string, recipients_to array<string>, recipients_cc array<string>, "
    "recipients_bcc array<string>, subject string, body string"
)


def tag(spark, rows, rules, **options):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA).repartition(1)
    return tag_accounts(df, rules, **options)


RULES = rules_from_config(yaml.safe_load(S.RULES))

# sender, to, cc, bcc, subject, body; then the account and the partners worked out by hand (domain 2, keyword 1, alias 1,
# two points are enough).
CASES = [
    # one word of one kind is one point
    ((None, None, None, None, "acme", None), None, []),
    ((None, None, None, None, None, "an RFP"), None, []),
    # alias and keyword, also in different fields and cases; several aliases count once
    ((None, None, None, None, "ACME", "about the rfp"), "Acme", []),
    ((None, None, None, None, "acme and Acme Inc", ""), None, []),
    # a domain is enough, from any address; it matches as a substring, in any case
    (("b@GLOBEX.example", None, None, None, "x", "y"), "Globex", []),
    (("x@y.z", ["a@acme.example"], [], None, None, None), "Acme", []),
    (("x@y.z", None, ["q@y.z", "a@acme.example"], None, None, None), "Acme", []),
    (("x@y.z", None, None, ["c@acme.example.evil"], None, None), "Acme", []),
    # of two accounts the first one named in the rules wins
    (("b@globex.example", ["a@acme.example"], None, None, None, None), "Acme", []),
    # partners follow from the text alone, in the rules' order, each once, with or without an account
    (("x@y.z", None, None, None, "Initech", "with GLOBEX and hooli"), None, ["Globex", "Initech", "Hooli"]),
    (("a@acme.example", None, None, None, "globex globex", None), "Acme", ["Globex"]),
    ((None, None, None, None, "globex", "invoice"), "Globex", ["Globex"]),
    # overrides come first, and tag no partners: the exact sender, then the first subject pattern
    (("boss@acme.example", None, None, None, "Ticket 4 urgent", "globex"), "Board", []),
    (("Boss@acme.example", None, None, None, "x", None), "Acme", []),
    ((None, None, None, None, "Ticket 12 URGENT: globex", None), "Helpdesk", []),
    ((None, None, None, None, "Re: Ticket 12 urgent", "invoice"), "Second", []),
    ((None, None, None, None, "ticket", "Ticket"), None, []),
    ((None, None, None, None, None, None), None, []),
]


def test_tags_of_hand_worked_messages(spark):
    got = {row.message_id: row for row in tag(spark, [case for case, _, _ in CASES], RULES).collect()}
    for number, (case, account, partners) in enumerate(CASES):
        row = got[number]
        assert (row.account_tag, row.partner_tags) == (account, partners), case
        want = [(account, "account")] * (account is not None) + [(p, "partner") for p in partners]
        assert [(t.tag, t.kind) for t in row.tags] == want


def test_partner_of_another_account_is_tagged_once(spark):
    rules = Rules(accounts=(
        Account("Heron", ("heron",), ("heron.example",), (), ("survey",)),
        Account("Plover", ("plover",), (), ("Heron",), ("nest",)),
        Account("Dunlin", ("dunlin",), (), ("Heron",), ("mud",)),
    ))
    row = ("k@x.example", None, ["w@heron.example"], None, "Field notes", "the Heron survey is done")
    tagged = tag(spark, [row], rules)
    assert [(r.tag, r.kind) for r in tag_rows(tagged).collect()] == [("Heron", "account"), ("Heron", "partner")]


def test_long_override_lists_are_joined(spark):
    listed = {f"person{i}@x.example": f"Desk {i % 7}" for i in range(3000)}
    rules = Rules(accounts=(Account("A", (), ("x.example",), ("Heron",), ()),), addresses=listed)
    rows = [("person8@x.example", None, None, None, "heron", ""), ("other@x.example", None, None, None, "heron", ""), (None, None, None, None, None, None)]
    tagged = tag(spark, rows, rules)
    got = {r.message_id: (r.account_tag, r.partner_tags) for r in tagged.collect()}
    assert got == {0: ("Desk 1", []), 1: ("A", ["Heron"]), 2: (None, [])}
    assert "_listed" not in tagged.columns and len(tagged._jdf.queryExecution().logical().toString()) < 50_000


def test_word_match(spark):
    rules = Rules(accounts=(Account("A", ("acme",), (), ("PO",), ("PO",)),))
    rows = [(None, None, None, None, "acme report", ""), (None, None, None, None, "acme PO.", "")]
    loose = [r.account_tag for r in tag(spark, rows, rules).orderBy("message_id").collect()]
    strict = [(r.account_tag, r.partner_tags) for r in tag(spark, rows, rules, match="word").orderBy("message_id").collect()]
    assert loose == ["A", "A"] and strict == [(None, []), ("A", ["PO"])]


def test_config(write):
    path = write("accounts.yml", S.RULES)
    rules = rules_from_config(load_config(str(path)))
    assert rules == RULES and rules.accounts[0].aliases == ("acme", "acme inc")
    assert rules_from_config({}) == Rules()
    with pytest.raises(re.error):
        rules_from_config({"overrides": {"subject_patterns": [{"pattern": "(", "account": "x"}]}})


def test_python_only_syntax_is_carried_over(spark):
    pattern = r"(?P<word>\w+) (?P=word)\b"
    texts = ["hé hé", "hé hét", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.hit for r in df.select(df.t.rlike(to_java(pattern)).alias("hit")).collect()]
    assert got == [bool(re.search(pattern, t)) for t in texts]
