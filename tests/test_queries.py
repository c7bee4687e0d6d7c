"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import math

import pytest

from quern.plans import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [{k: norm(v) for k, v in r.asDict().items()} for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = [{k: norm(v) for k, v in r.items()} for r in duck(sql, SF)]
    assert not want or sorted(want[0]) == sorted(df.columns)
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, want))
