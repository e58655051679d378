"""Stored tables (S4-S8, G3, L3) and small scalar operators."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quoteflow.functions import orders as OF
from quoteflow.operators import ledger, listings, pnl, strategy


def test_listing_completeness(spark):
    p = spark.createDataFrame([("bitfinex", 1, "[]"), ("bitstamp", 1, "[]"), ("kraken", 1, "{}"),
                               ("bitfinex", 2, "[]"), ("kraken", 2, None)],
                              "source string, fetch_id long, payload string")
    got = {r.fetch_id: r.complete for r in listings.complete_sources(p).collect()}
    assert got == {1: True, 2: False}


def test_cross_traded_store_keeps_duplicates(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="qf-store-"), "pairs")
    cross = spark.createDataFrame([("BTC", "USD", "BTC-USD", 2, 2)],
                                  "currency1 string, currency2 string, pair string, n_listings long, n_exchanges long")
    listings.store_cross_traded(cross, path)
    listings.store_cross_traded(cross, path)
    assert [r.pair for r in listings.stored_pairs(spark, path).collect()] == ["BTC-USD", "BTC-USD"]


def test_strategy_store_latest_valid_wins(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="qf-store-"), "strategies")
    cols = ("strategy_id long, number_of_currencies int, minimal_price_spread double, min_transaction_profit double, "
            "maximal_transaction_value double, maximal_trading_value double, init_investment double")
    strategy.save(spark.createDataFrame([(1, 2, 1.0, 1.0, 5.0, 10.0, 100.0)], cols), path)
    strategy.save(spark.createDataFrame([(2, 0, 1.0, 1.0, 5.0, 10.0, 100.0)], cols), path)  # invalid
    assert strategy.load_current(spark, path).first().strategy_id == 1


def test_logs_lookup_and_snapshot(spark):
    d = tempfile.mkdtemp(prefix="qf-log-")
    rows = spark.createDataFrame([("o1", 1, "Pending"), ("o1", 2, "FullyFilled"), ("o2", 1, "Pending")],
                                 "order_id string, version int, status string")
    ledger.append_log(rows, os.path.join(d, "orders"))
    log = spark.read.parquet(os.path.join(d, "orders"))
    assert ledger.first_match(log, "order_id", "o1", ["version"]).first().status == "Pending"
    ledger.snapshot(log.where("order_id = 'o2'"), os.path.join(d, "history"))
    h = spark.read.parquet(os.path.join(d, "history")).first()
    assert h.order_id == "o2" and h.history_ts is not None


def test_submitted_order_ids(spark):
    df = spark.createDataFrame([
        ("Bitfinex", '[0,0,0,0,[[123456,1,2]]]'),
        ("Kraken", '{"error":[],"result":{"txid":["OABC-123"]}}'),
        ("Bitstamp", '{"id":"9876","status":"Open"}'),
        ("Other", '{}')], "exchange string, payload string")
    got = [r.i for r in df.select(OF.submitted_order_id(F.col("exchange"), F.col("payload")).alias("i")).collect()]
    assert got == ["123456", "OABC-123", "9876", None]


def test_unknown_order_type_raises_in_strict_mode(spark):
    o = spark.createDataFrame([("P1", "o1", "BUY", Decimal(1), Decimal(2), dt.datetime(2024, 1, 1)),
                               ("P1", "o2", "hold", Decimal(1), Decimal(2), dt.datetime(2024, 1, 1))],
                              "currency_pair string, order_id string, type string, filled_quantity decimal(18,8), "
                              "order_price decimal(18,8), ts timestamp")
    lenient = {r.order_id: r.side for r in pnl.order_to_trade(o, strict=False).collect()}
    assert lenient == {"o1": "buy", "o2": None}
    with pytest.raises(Exception, match="Unknown order type"):
        pnl.order_to_trade(o).collect()


def test_size_for_input(spark):
    from conftest import SF_SMALL
    from quoteflow.session import input_bytes, size_for_input
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.files.maxPartitionBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    assert input_bytes(spark, [os.path.join(SF_SMALL, "lineitem.parquet")]) > 0
    n = size_for_input(spark, 100 << 40)          # 100 TB on disk
    assert n > 1_000_000 and spark.conf.get("spark.sql.shuffle.partitions") == str(n)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_incomplete_fetch_is_not_used(spark):
    p = spark.createDataFrame([
        ("bitfinex", 1, '[["BTC:USD"]]'), ("bitstamp", 1, '[{"name":"BTC/USD"}]'),
        ("kraken", 1, '{"error":[],"result":{"a":{"wsname":"ETH/USD"}}}'),
        ("bitfinex", 2, '[["ETH:USD"]]'), ("bitstamp", 2, '[{"name":"ETH/USD"}]')],   # kraken missing
        "source string, fetch_id long, payload string")
    assert [r.pair for r in listings.identify_cross_traded(p).collect()] == ["BTC-USD"]


def test_transaction_status_update_results(spark):
    state = spark.createDataFrame([("t1", "Submitted"), ("t2", "Fulfilled")], "transaction_id string, status string")
    upd = spark.createDataFrame([("t1", "Fulfilled"), ("t2", "Fulfilled"), ("t9", "Cancelled")],
                                "transaction_id string, new_status string")
    got = {r.transaction_id: (r.status, r.result) for r in ledger.update_transaction_status(state, upd).collect()}
    assert got == {"t1": ("Fulfilled", ledger.MSG_TX_UPDATED),
                   "t2": ("Fulfilled", ledger.MSG_TX_NOT_FOUND),      # unchanged: nothing modified
                   "t9": (None, ledger.MSG_TX_NOT_FOUND)}


def test_store_history_reports_missing_ids(spark):
    d = tempfile.mkdtemp(prefix="qf-hist-")
    state = spark.createDataFrame([("t1", "Submitted")], "transaction_id string, status string")
    ids = spark.createDataFrame([("t1",), ("t2",)], "transaction_id string")
    got = {r.transaction_id: r.result for r in ledger.store_history(state, ids, os.path.join(d, "h")).collect()}
    assert got == {"t1": ledger.MSG_HISTORY_STORED, "t2": ledger.MSG_HISTORY_NOT_FOUND}
    assert [r.transaction_id for r in spark.read.parquet(os.path.join(d, "h")).collect()] == ["t1"]


def test_updates_of_one_transaction_go_one_after_the_other(spark):
    state = spark.createDataFrame([("t1", "Submitted"), ("t2", "Fulfilled")], "transaction_id string, status string")
    ups = [("t1", 1, "Submitted"), ("t1", 2, "Fulfilled"), ("t1", 3, "Submitted"), ("t2", 1, "Fulfilled"), ("x", 1, "Submitted"),
           ("x", 2, "Fulfilled"), (None, 1, "Submitted")]
    got = ledger.update_transaction_status(state, spark.createDataFrame(ups, "transaction_id string, v int, new_status string"), ("v",))
    by = {(r.transaction_id, r.v): (r.status, r.result == ledger.MSG_TX_UPDATED) for r in got.collect()}
    assert by == {("t1", 1): ("Submitted", False), ("t1", 2): ("Fulfilled", True), ("t1", 3): ("Submitted", True),
                  ("t2", 1): ("Fulfilled", False), ("x", 1): (None, False), ("x", 2): (None, False), (None, 1): (None, False)}


def test_previous_in_key_over_many_blocks(spark):
    import random
    from quoteflow.operators.running import dense_order, previous_in_key
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), i, r.randrange(9)) for i in range(700)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    before = {}
    for k, o, v in sorted(rows, key=lambda x: x[1]):
        before[o] = (before.get((k, "last")), sum(1 for x in rows if x[0] == k and x[1] < o))
        before[(k, "last")] = v
    got = {x.o: x.p for x in previous_in_key(df, "k", ["o"], "v", "p", 9).collect()}
    assert got == {o: before[o][0] for _, o, _ in rows}
    got = {x.o: x.n for x in dense_order(df.where("k is not null"), ["k"], ["o"], "n", 9).collect()}
    assert got == {o: before[o][1] for k, o, _ in rows if k}
    assert sorted(x.n for x in dense_order(df, [], ["o"], "n", 9).collect()) == list(range(700))


def test_lookup_reports_what_is_not_there(spark):
    state = spark.createDataFrame([("o1", "Pending"), ("o1", "Filled"), ("o2", "Pending")], "order_id string, status string")
    keys = spark.createDataFrame([("o1",), ("o3",), ("o3",), (None,)], "order_id string")
    got = {r.order_id: (r.status, r.error) for r in ledger.find(state, keys, "order_id").collect()}
    assert got == {"o1": ("Filled", None), "o3": (None, "Order not found"), None: (None, "Order not found")}


def test_change_log_batches_and_compaction(spark):
    from quoteflow.operators.change_log import ChangeLog
    path = os.path.join(tempfile.mkdtemp(prefix="qf-log-"), "orders")
    kind = "order_id string, version long, status string"

    def log():
        return ChangeLog(spark, path, kind, "order_id", buckets=8)

    def state():
        return sorted(map(tuple, log().state().collect()))

    def rows(*r):
        return spark.createDataFrame(r, kind)

    assert state() == []
    assert log().append(rows(("a", 0, "Pending"), ("b", 0, "Pending")), 0)
    assert log().append(rows(("a", 1, "Filled"), ("z", 1, "Filled")), 1) and not log().append(rows(("a", 9, "twice")), 1)
    want = [("a", 1, "Filled", 0), ("b", 0, "Pending", 0), ("z", 1, "Filled", 1)]
    assert state() == want
    log().compact()
    assert state() == want
    assert not log().append(rows(("a", 9, "twice")), 1)                # known from the snapshot too
    # a batch that was written but not committed takes no effect until it is repeated
    rows(("b", 5, "lost")).write.parquet(f"{path}/log/batch=2")
    assert state() == want and log().append(rows(("b", 2, "Half"), ("c", 0, "Pending")), 2)
    want = [("a", 1, "Filled", 0), ("b", 2, "Half", 0), ("c", 0, "Pending", 0), ("z", 1, "Filled", 1)]
    assert state() == want
    plan = log().state()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 8 out of 8" in plan
    log().compact()
    log().compact()                                                      # nothing new
    assert log().append(rows(("c", 1, "Filled")), 3)
    log().compact()
    want[2] = ("c", 1, "Filled", 0)
    assert state() == want and not log().append(rows(("q", 1, "twice")), 0)
    # a session that has never seen the snapshot's table
    spark.sql(f"DROP TABLE {log()._name(3)}")
    assert state() == want and sorted(os.listdir(path)) == ["commits", "log", "snapshot-2", "snapshot-3"]
