"""Every query against its SQL on the smallest tables."""

import math

import pytest

from tests.conftest import SF
from webloom.plans.catalog import ORACLES, QUERIES


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert rows
    told = duck.execute(ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert rows == sorted(([plain(r[names.index(c)]) for c in columns] for r in told.fetchall()), key=repr)
