import datetime as dt
import decimal

import pytest

from tests import oracle
from tidemark.plans import registry

SQL = registry.oracle_sql()


def plain(rows):
    names, values = rows
    kept = []
    for row in values:
        kept.append(tuple(float(x) if isinstance(x, decimal.Decimal) else x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x for x in row))
    return names, sorted(kept, key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_against_sql(spark, sf_dir, name):
    assert plain(oracle.rows(registry.queries()[name](spark, sf_dir))) == plain(oracle.run(SQL[name], sf_dir))


def test_every_query_has_sql():
    assert registry.queries().keys() == SQL.keys()
