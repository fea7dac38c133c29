"""Operators that SQL can express, against their SQL."""

import pytest

from tests.conftest import SF
from webloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_form(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.execute(oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in told.fetchall())
