"""Live detection replay: carry-forward blocks, tie order, once-only, budget."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quoteflow.operators import opportunities as O
from quoteflow.sources import adapters

P = O.TradingParams(min_spread=1.0, min_profit=1.0, max_transaction_value=1000.0, max_trading_value=150.0)


def ticks(spark, rows):
    """rows: (seq, pair, x, bp, bs, ap, as)"""
    rows = [(s, p, x, *map(float, rest)) for s, p, x, *rest in rows]
    return spark.createDataFrame(rows, "seq long, pair string, x int, bp double, bs double, ap double, `as` double")


def rows_of(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_small_blocks_equal_one_block(spark):
    t = adapters.live_quotes(spark, SF_SMALL)
    cols = ["pair", "seq", "x", "q_seq", "bp", "ap"]
    a = rows_of(O.latest_quote_grid(t, block_size=7), cols)
    b = rows_of(O.latest_quote_grid(t), cols)
    assert a == b and len(a) > 0


def test_grid_is_latest_earlier_quote_of_each_exchange(spark):
    t = ticks(spark, [(1, "A", 2, 10, 1, 11, 1), (2, "A", 6, 20, 1, 21, 1), (3, "A", 2, 12, 1, 13, 1),
                      (4, "B", 2, 1, 1, 2, 1)])
    g = rows_of(O.latest_quote_grid(t, block_size=2), ["seq", "x", "q_seq"])
    assert g == [(1, 2, 1), (2, 2, 1), (2, 6, 2), (3, 2, 3), (3, 6, 2), (4, 2, 4)]


def test_best_ties_follow_cache_key_string_order(spark):
    # Buying on 23 or on 6 and selling on 2 give equal profit; "23" < "6" as strings.
    t = ticks(spark, [(1, "A", 6, 1, 5, 10, 5), (2, "A", 23, 1, 5, 10, 5), (3, "A", 2, 20, 5, 30, 5)])
    best = O.best_opportunity(O.latest_quote_grid(t), P).where("seq = 3").collect()
    assert [(b.buy_x, b.sell_x) for b in best] == [(23, 2)]


def test_once_only_and_budget_clip(spark):
    # Same best opportunity on ticks 3 and 4 executes once; value 10*10=100 then
    # the second pair's 10*10=100 is clipped to the remaining 50 (quantity 5).
    t = ticks(spark, [(1, "A", 6, 1, 10, 10, 10), (2, "A", 2, 30, 10, 40, 10), (3, "A", 2, 30, 10, 40, 10),
                      (4, "B", 6, 1, 10, 10, 10), (5, "B", 2, 30, 10, 40, 10), (6, "C", 6, 1, 10, 10, 10),
                      (7, "C", 2, 30, 10, 40, 10)])
    best = O.best_opportunity(O.latest_quote_grid(t), P)
    ex = O.executed_opportunities(best, P).orderBy("seq").collect()
    assert [(e.pair, e.seq, e.quantity) for e in ex] == [("A", 2, 10.0), ("B", 5, 5.0)]
    assert ex[0].buy_exchange == "Bitstamp" and ex[0].sell_exchange == "Bitfinex"


def test_thresholds_are_inclusive_and_exchanges_differ(spark):
    # spread exactly 1 and profit exactly 1 pass (>=); one exchange alone never trades.
    t = ticks(spark, [(1, "A", 6, 0, 1, 9, 1), (2, "A", 2, 10, 1, 99, 1), (3, "B", 2, 50, 5, 1, 5)])
    opp = O.opportunities(O.latest_quote_grid(t), P).collect()
    assert [(o.seq, o.buy_x, o.sell_x, o.profit) for o in opp] == [(2, 6, 2, 1.0)]


def test_exchange_names_default(spark):
    from quoteflow.functions.pairs import exchange_name
    df = spark.range(1).select(*[exchange_name(F.lit(i)).alias(f"e{i}") for i in (2, 6, 23, 99)])
    assert tuple(df.first()) == ("Bitfinex", "Bitstamp", "Kraken", "Exchange99")
