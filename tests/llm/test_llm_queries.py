"""The registered queries that SQL can express, against it."""

import pytest
from oracle import compare

from tidemark.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    compare(llm.queries()[name](spark, f"/root/testdata/{sf}"), llm.oracle_sql()[name], f"/root/testdata/{sf}")
