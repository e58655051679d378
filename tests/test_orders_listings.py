"""Listing parsers, fill parsing, remainder chains, order state, strategies."""

from decimal import Decimal

from pyspark.sql import functions as F

from quoteflow.operators import ledger, listings, orders, strategy


def payloads(spark, rows):
    return spark.createDataFrame(rows, "source string, fetch_id long, payload string")


def test_listing_parsers(spark):
    p = payloads(spark, [
        ("bitfinex", 1, '[["BTC:USD","ETHUSD","ABCD:USD","ETH:EUR"]]'),
        ("bitfinex", 2, '[["BTC:USD"],["ETH:USD"]]'),        # outer size 2: dropped
        ("bitstamp", 1, '[{"name":"BTC/USD"},{"name":"BTC/USDT"},{"name":"ETH/EUR"}]'),
        ("kraken", 1, '{"error":[],"result":{"XBTUSD":{"wsname":"BTC/USD"},"X":{"wsname":"LTC/USD"}}}'),
        ("kraken", 2, '{"error":["EAPI:x"],"result":{"A":{"wsname":"DOT/USD"}}}'),  # error: dropped
        ("kraken", 3, "not json"),
    ])
    got = sorted((r.source, r.currency1, r.currency2) for r in listings.all_listings(p).collect())
    assert got == [("bitfinex", "BTC", "USD"), ("bitfinex", "ETH", "EUR"), ("bitstamp", "BTC", "USD"),
                   ("bitstamp", "ETH", "EUR"), ("kraken", "BTC", "USD"), ("kraken", "LTC", "USD")]
    cross = {r.pair: (r.n_listings, r.n_exchanges) for r in listings.cross_traded(listings.all_listings(p)).collect()}
    assert cross == {"BTC-USD": (3, 3), "ETH-EUR": (2, 2)}


def test_cross_traded_counts_duplicates_on_one_venue(spark):
    p = payloads(spark, [("bitstamp", 1, '[{"name":"BTC/USD"},{"name":"BTC/USD"}]')])
    l = listings.all_listings(p)
    assert [r.pair for r in listings.cross_traded(l).collect()] == ["BTC-USD"]
    assert listings.cross_traded(l, strict=True).count() == 0


def test_cross_traded_counts_within_one_fetch(spark):
    p = payloads(spark, [("bitfinex", 1, '[["LTC:USD"]]'), ("bitfinex", 2, '[["LTC:USD"]]'),
                         ("bitstamp", 2, '[{"name":"DOT/EUR"}]'), ("kraken", 2, '{"error":[],"result":{"A":{"wsname":"DOT/EUR"}}}')])
    got = [(r.pair, r.n_listings, r.n_exchanges) for r in listings.cross_traded(listings.all_listings(p)).collect()]
    assert got == [("DOT-EUR", 2, 2)]


def test_fill_parsing_per_venue(spark):
    o = spark.createDataFrame([
        ("1", "Bitfinex", Decimal("5")), ("2", "Kraken", Decimal("5")), ("3", "Bitstamp", Decimal("5")),
        ("4", "Kraken", Decimal("5"))], "order_id string, exchange string, order_quantity decimal(18,8)")
    r = spark.createDataFrame([
        ("Bitfinex", "1", '[[1,0,0,"tBTCUSD",-2.5]]'),
        ("Kraken", "2", '{"error":[],"result":{"2":{"vol_exec":"5.0"}}}'),
        ("Bitstamp", "3", '{"id":"3","amount_remaining":"5"}')], "exchange string, order_id string, payload string")
    got = {x.order_id: (x.filled, x.status) for x in orders.fill_status(orders.fill_amounts(o, r)).collect()}
    assert got == {"1": (Decimal("2.5"), "PartiallyFulfilled"), "2": (Decimal("5"), "FullyFilled"),
                   "3": (Decimal("0"), "NotFilled")}
    missing = orders.fill_amounts(o, r).where("order_id = '4'").first()
    assert not missing.has_report


def test_reports_without_a_quantity_are_unreadable(spark):
    o = spark.createDataFrame([("1", "Bitfinex", Decimal("5")), ("2", "Kraken", Decimal("5")), ("3", "Elsewhere", Decimal("5"))],
                              "order_id string, exchange string, order_quantity decimal(18,8)")
    r = spark.createDataFrame([("Bitfinex", "1", "[[1,0,"), ("Kraken", "2", '{"error":["EOrder:Unknown"]}'),
                               ("Elsewhere", "3", '{"filled":5}')], "exchange string, order_id string, payload string")
    s = orders.fill_status(orders.fill_amounts(o, r))
    assert [(x.filled, x.status) for x in s.collect()] == [(None, "Unreadable")] * 3
    assert orders.readable(s).count() == 0


def test_remainder_chain(spark):
    a = spark.createDataFrame([
        ("t", "buy", 1, "a", Decimal("10"), Decimal("4")),
        ("t", "buy", 2, "b", Decimal("99"), Decimal("3")),
        ("t", "buy", 3, "c", Decimal("99"), Decimal("3")),   # 3 >= 10-4-3: full, chain stops
        ("t", "buy", 4, "d", Decimal("99"), Decimal("1")),
        ("u", "sell", 1, "e", Decimal("10"), Decimal("0"))],
        "transaction_id string, type string, attempt int, order_id string, "
        "order_quantity decimal(18,8), filled_quantity decimal(18,8)")
    got = {r.transaction_id: (r.attempts, r.total_filled, r.final_status, r.remaining)
           for r in orders.order_chain(a).collect()}
    assert got == {"t": (3, Decimal("10"), "FullyFilled", Decimal("0")),
                   "u": (1, Decimal("0"), "NotFilled", Decimal("10"))}


def test_latest_orders_reports_unmatched_updates(spark):
    created = spark.createDataFrame([("a", "Pending", Decimal(0))], "order_id string, status string, "
                                                                    "filled_quantity decimal(18,8)")
    upd = spark.createDataFrame([("a", 1, "FullyFilled", Decimal(3)), ("z", 1, "NotFilled", Decimal(0))],
                                "order_id string, version int, status string, filled_quantity decimal(18,8)")
    got = {r.order_id: (r.status, r.result) for r in orders.latest_orders(created, upd).collect()}
    assert got == {"a": ("FullyFilled", "Success"), "z": ("NotFilled", "No order updated")}


def test_order_legs_are_stable_and_signed(spark):
    ex = spark.createDataFrame([("BTC-USD", 7, 6, 23, "Bitstamp", "Kraken", 10.0, 12.0, 2.0)],
                               "pair string, seq long, buy_x int, sell_x int, buy_exchange string, "
                               "sell_exchange string, buy_price double, sell_price double, quantity double")
    legs = {r.type: r for r in orders.order_legs(ex).collect()}
    assert legs["buy"].transaction_id == legs["sell"].transaction_id
    assert legs["buy"].symbol == "btcusd" and legs["sell"].symbol == "XXBTCUSD"
    assert legs["sell"].signed_amount == 2.0 and legs["buy"].status == "Pending"
    assert orders.order_legs(ex).first().transaction_id == legs["buy"].transaction_id
    on_bitfinex = orders.order_legs(ex.replace("Kraken", "Bitfinex", ["sell_exchange"])).where("type = 'sell'").first()
    assert on_bitfinex.signed_amount == -2.0


def test_strategy_validation_order(spark):
    cols = ("strategy_id long, number_of_currencies int, minimal_price_spread double, min_transaction_profit double, "
            "maximal_transaction_value double, maximal_trading_value double, init_investment double")
    df = spark.createDataFrame([
        (1, 0, -1.0, 0.0, -1.0, -1.0, -1.0), (2, 1, 0.0, 0.0, -1.0, 1.0, 1.0), (3, 1, 1.0, -5.0, 0.5, 1.0, 1.0),
        (4, 1, 1.0, -5.0, 2.0, 1.0, 1.0), (5, 1, 1.0, 0.0, 2.0, 1.0, 0.0)], cols)
    got = {r.strategy_id: r.error for r in strategy.validate(df).collect()}
    assert got == {1: strategy.MSG_CURRENCIES, 2: strategy.MSG_SPREAD, 3: strategy.MSG_TX_BELOW_SPREAD,
                   4: None, 5: strategy.MSG_INVESTMENT}
    assert strategy.current_strategy(strategy.validate(df)).first().strategy_id == 4
    assert {r.maximal_trading_value for r in strategy.set_maximal_trading_value(df, 9.0).collect()} == {9.0}


def test_transaction_history_ranges(spark):
    import datetime as dt
    d = dt.datetime(2024, 1, 1)
    o = spark.createDataFrame([("t1", 1, "a", "FullyFilled", d), ("t1", 2, "b", "FullyFilled", d + dt.timedelta(1))],
                              "transaction_id string, attempt int, order_id string, status string, ts timestamp_ntz")
    h = ledger.transaction_history(ledger.transaction_events(o)).orderBy("version").collect()
    assert [(r.version, r.status, r.order_ids, r.valid_to) for r in h] == [
        (1, "Submitted", "b,a", d + dt.timedelta(1)), (2, "Fulfilled", "b,a", None)]
    cur = ledger.lookup(ledger.latest_transactions(ledger.transaction_events(o)),
                        spark.createDataFrame([("t1",)], "transaction_id string"), "transaction_id")
    assert cur.first().status == "Fulfilled"
    assert F is not None
