import os

import oracle
import pytest

from ledgerview.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert oracle.difference(registry.queries()[name](spark, SF), oracle.connect(SF), registry.oracle_sql()[name]) == ""


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in registry.queries()} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
