"""The text queries that have SQL, against it, on the smallest tables; the others run."""

import pytest
from oracle import same

from chronoweave.llm.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert same(df, SQL[name], small) == ""
    else:
        assert df.columns and df.count() >= 0
