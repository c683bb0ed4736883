"""The series under the queries hold every row of their tables."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import roles

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_totals_hold_every_order(spark):
    want = roles.table(spark, SF, "orders").agg(F.sum("o_totalprice") / roles.SCALE).first()[0]
    full, gappy = roles.totals(spark, SF), roles.gappy_totals(spark, SF)
    for series in (full, gappy):
        assert series.agg(F.sum("value")).first()[0] == pytest.approx(want, rel=1e-12)
    months = [{r["month"] for r in s.select("month").distinct().collect()} for s in (full, gappy)]
    lost = sorted(months[0] - months[1])
    assert len(lost) >= 12 and len(months[0]) >= 75


def test_series_hold_every_item(spark):
    from tidemark.plans import flag_metrics, model_queries

    items = roles.table(spark, SF, "lineitem")
    quantity = items.agg(F.sum("l_quantity")).first()[0]
    assert roles.shipped(spark, SF).agg(F.sum("cnt")).first()[0] == items.count()
    assert flag_metrics.three_series(spark, SF).agg(F.sum("a")).first()[0] == pytest.approx(quantity)
    assert model_queries.supplier_series(spark, SF).count() == items.select("l_suppkey", F.trunc("l_shipdate", "MM")).distinct().count()
