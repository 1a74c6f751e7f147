"""Every registered query: against its SQL where there is one; otherwise that it runs and gives rows."""

import pytest

from compare import check
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        check(df, sql, sf_dir)
    else:
        assert df.count() > 0
