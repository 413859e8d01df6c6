"""Every query of the core against its SQL on the smallest tables."""

import pytest
from oracle import same

from chronoweave.plans import load

REGISTRY = load()
NAMES = sorted(REGISTRY.queries)


#: Their columns are the fields of the files at this scale.
MEDIUM, OF_MEDIUM = "/root/testdata/sf0.01", ("p6_supply_chain", "p6_gdelt")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    small = MEDIUM if name in OF_MEDIUM else small
    df = REGISTRY.queries[name](spark, small)
    if name in REGISTRY.sql:
        assert same(df, REGISTRY.sql[name], small) == ""
    else:
        assert df.columns and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(REGISTRY.sql) <= set(REGISTRY.queries)
