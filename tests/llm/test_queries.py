"""Registered queries against their SQL, on the smallest given tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import rows_of  # noqa: E402
from mailtables.llm.oracles import ORACLES  # noqa: E402
from mailtables.llm.queries import QUERIES  # noqa: E402


def test_registered():
    numbers = {name.partition("_")[0] for name in QUERIES}
    assert {f"op{n}" for n in range(1, 11)} <= numbers
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, sf, name):
    frame = QUERIES[name](spark, sf)
    result = con.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, result.fetchall())
