"""Queries equal their SQL."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from tillbook.llm.oracles import ORACLES


@pytest.mark.parametrize("name", ORACLES)
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, name, sf):
    found = differences(contract.queries()[name], contract.oracle_sql()[name], spark, connect(sf), f"/root/testdata/sf{sf}")
    assert found is None


def test_every_operator_is_registered_once():
    names = [n for n in contract.queries() if n.startswith("op") and n[2:].split("_")[0].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()
