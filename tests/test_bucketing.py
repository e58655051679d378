"""Orders and fill reports stored bucketed on (exchange, order_id) join
without a shuffle, with the same result as the unbucketed join."""

from conftest import SF_SMALL
from quoteflow.operators import orders
from quoteflow.sources import adapters
from quoteflow.sources.tables import save_bucketed


def test_bucketed_fill_join_has_no_exchange(spark):
    save_bucketed(adapters.orders(spark, SF_SMALL), "qf_orders_b", ["exchange", "order_id"], 8)
    save_bucketed(adapters.fill_reports(spark, SF_SMALL), "qf_reports_b", ["exchange", "order_id"], 8)
    o, r = spark.table("qf_orders_b"), spark.table("qf_reports_b")
    fills = orders.fill_amounts(o, r)
    plan = fills._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    want = orders.fill_amounts(adapters.orders(spark, SF_SMALL), adapters.fill_reports(spark, SF_SMALL))
    key = lambda df: sorted(tuple(x) for x in df.select("order_id", "filled", "has_report").collect())
    assert key(fills) == key(want)
