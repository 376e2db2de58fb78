"""Every registered query with SQL gives that SQL's rows; the others run with a stable schema."""

from __future__ import annotations

import pytest
from compare import duck, spark_rows

from glintframe import plans

ORACLES = plans.oracles()


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert spark_rows(plans.queries()[name](spark, sf)) == duck(ORACLES[name], sf)


@pytest.mark.parametrize("name", [k for k in plans.queries() if k not in ORACLES])
def test_runs(spark, sf, name):
    df = plans.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["part", "key", "metric", "value"] and df.count() > 10


def test_registered_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
