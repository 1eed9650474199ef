"""Queries of the subpackage with SQL give the SQL's rows over whole tables."""

import pytest

from quillstone.llm import queries

from ..oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    want = rows(connect(SF).execute(queries.ORACLES[name]).df())
    got = queries.QUERIES[name](spark, SF).select(*want[0]).toPandas()
    assert rows(got) == want and want[1]
