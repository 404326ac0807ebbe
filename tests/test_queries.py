"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences

import __spark_entry__
from delaylake.plans import registry


@pytest.mark.parametrize("name", list(registry.oracles()))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, registry.queries()[name], registry.oracles()[name], sf_dir) == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["band", "n", "timetable", "naive", "official"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(registry.oracles()) <= set(__spark_entry__.oracle_sql())


def test_longest_pattern_keeps_little_of_a_line_item(spark, tmp_path):
    from datetime import datetime

    from delaylake.plans import driver_queries

    day = lambda n: datetime(1995, 1, n)
    item = lambda o, n, supp, d: (o, 1, supp, n, 1.0, 1.0, 0.0, 0.0, "N", "O", day(d))
    types = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    # order 1 has more rows, orders 2 and 3 more stops; of the copies of a stop the first shipped counts, of orders as long the least
    rows = [item(1, 1, 10, d) for d in range(1, 6)] + [item(2, 2, 22, 1), item(2, 1, 21, 4), item(2, 1, 20, 3), item(3, 1, 30, 1), item(3, 2, 31, 1), item(4, 7, 40, 1)]
    spark.createDataFrame(rows, types).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(o, 1, status, 1.0, day(1), "1-URGENT") for o, status in ((1, "F"), (2, "F"), (3, "F"), (4, "O"), (5, "P"))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = driver_queries.q21(spark, str(tmp_path))
    # the rows that are sorted for their first shipping are those of the few journeys found
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("l_shipdate") < plan.rindex("LeftSemi") and "count(distinct" not in plan
    assert {tuple(r) for r in got.collect()} == {("1-URGENT", "F", "20>22"), ("1-URGENT", "O", "40")}


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    from delaylake.plans import driver_queries

    monkeypatch.setattr(driver_queries, "TASK_ROWS", 100)
    assert driver_queries.spread(spark.range(1950), "id").rdd.getNumPartitions() == 20
    assert driver_queries.spread(spark.range(50), "id").rdd.getNumPartitions() <= 4
