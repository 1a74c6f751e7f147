"""The registered queries with SQL, whole, and the shape of the others."""

import pytest

from compare import check
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    check(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)
