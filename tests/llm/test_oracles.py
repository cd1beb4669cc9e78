"""The corpus queries that SQL can express, against their SQL."""

import pytest
from test_queries import SF, duck, values  # noqa: F401

from partita.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    assert values(QUERIES[name](spark, SF).toPandas()) == values(duck.execute(ORACLES[name]).df())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
