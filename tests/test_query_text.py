"""Search text: precedence, quotes and errors, and the rows of a condition written by hand."""

import pytest

from mailtables.plans import query_text as Q
from mailtables.plans import search


def test_trees():
    assert Q.parse("invoice AND (Acme OR Contoso)") == (
        "and", [("term", "invoice"), ("or", [("term", "Acme"), ("term", "Contoso")])])
    assert Q.parse("a OR b c NOT d") == ("or", [("term", "a"), ("and", [("term", "b"), ("term", "c"), ("not", ("term", "d"))])])
    assert Q.parse('"AND or" NOT NOT x') == ("and", [("term", "AND or"), ("not", ("not", ("term", "x")))])
    assert Q.parse(r'"say \"hi\""') == ("term", 'say "hi"')
    assert Q.parse("and or") == ("and", [("term", "and"), ("term", "or")])


@pytest.mark.parametrize("text", ["", "   ", "a AND", "OR b", "(a", "a)", "NOT", '"open', "a () b", "a AND OR b"])
def test_malformed(text):
    with pytest.raises(ValueError):
        Q.condition(text)


def test_rows(spark):
    rows = [(1, "Invoice", "from Acme"), (2, "invoice", "contoso"), (3, None, "invoice only"), (4, "acme", None),
            (5, "INVOICE", "ACME and Contoso"), (6, None, None), (7, "AND or", "x")]
    df = spark.createDataFrame(rows, "message_id int, subject string, body string")
    got = lambda text: sorted(r[0] for r in df.where(Q.condition(text)).collect())
    assert got("invoice AND (Acme OR Contoso)") == [1, 2, 5]
    want = search.matches_terms(all_of=["invoice"], any_of=["Acme", "Contoso"])
    assert got("invoice AND (Acme OR Contoso)") == sorted(r[0] for r in df.where(want).collect())
    assert got("NOT invoice") == [4, 6, 7]
    assert got('"AND or"') == [7]
