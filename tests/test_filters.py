"""Filters that users put together."""

import pytest

from tickloom.functions.filters import filtered
from tickloom.sources.bars import table


def test_filters_reach_the_scan(spark, sf):
    tree = {"and": [{"column": "o_custkey", "is": ">=", "value": 7}, {"column": "o_orderstatus", "is": "in", "value": ["F", "O"]}, {"column": "o_orderpriority", "is": "starts", "value": "1"}, {"column": "o_orderdate", "is": "<", "value": "1997-01-01"}]}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = filtered(table(spark, sf, "orders"), tree).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("GreaterThanOrEqual(o_custkey,7)", "In(o_orderstatus, [F,O])", "StringStartsWith(o_orderpriority,1)", "LessThan(o_orderdate"):
        assert part in pushed
    assert "o_totalprice" not in plan


def test_names_types_and_empty_trees(spark):
    df = spark.createDataFrame([(1, "x' or 1=1 --", True), (2, None, None)], "`a.b``c` int, s string, t boolean")
    keep = lambda tree: sorted(r[0] for r in filtered(df, tree).collect())
    one = lambda c, how, v: {"column": c, "is": how, "value": v}
    assert keep(None) == keep({"and": []}) == [1, 2] and keep({"or": []}) == keep(one("s", "in", [])) == []
    assert keep(one("s", "=", "x' or 1=1 --")) == keep(one("a.b`c", "<", 1.5)) == keep(one("t", "=", True)) == [1] and keep(one("s", "null", True)) == [2]
    for bad in (one("z", "=", 1), one("s", "like", "x"), one("s", "=", 1), one("a.b`c", "=", "1"), one("t", "=", 1), one("s", "=", None), one("a.b`c", "starts", "1"), {"column": "s"}, {}):
        with pytest.raises(ValueError):
            filtered(df, bad)
