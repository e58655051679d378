"""Explicit schemas of the engine's inputs (no inference at scale)."""

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 8)

# Historical quote tick as landed from the market-data feed: prices and sizes
# are exact decimals, t is the exchange timestamp (epoch ms), x the exchange
# id, r the receive time (epoch ms). ``seq`` is the arrival ordinal.
QUOTE = T.StructType([
    T.StructField("ev", T.StringType()),
    T.StructField("pair", T.StringType()),
    T.StructField("lp", PRICE),
    T.StructField("ls", PRICE),
    T.StructField("bp", PRICE),
    T.StructField("bs", PRICE),
    T.StructField("ap", PRICE),
    T.StructField("as", PRICE),
    T.StructField("t", T.LongType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("r", T.LongType()),
])

# Live tick: same fields minus r, prices and sizes as double.
LIVE_QUOTE = T.StructType([
    T.StructField("ev", T.StringType()),
    T.StructField("pair", T.StringType()),
    T.StructField("lp", T.DoubleType()),
    T.StructField("ls", T.DoubleType()),
    T.StructField("bp", T.DoubleType()),
    T.StructField("bs", T.DoubleType()),
    T.StructField("ap", T.DoubleType()),
    T.StructField("as", T.DoubleType()),
    T.StructField("t", T.LongType()),
    T.StructField("x", T.IntegerType()),
])

# Listing payload shapes of the three exchanges.
BITFINEX_LISTING = T.ArrayType(T.ArrayType(T.StringType()))
BITSTAMP_LISTING = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
KRAKEN_LISTING = T.StructType([
    T.StructField("error", T.ArrayType(T.StringType())),
    T.StructField("result", T.MapType(T.StringType(),
                                      T.StructType([T.StructField("wsname", T.StringType())]))),
])

ORDER = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("currency_pair", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("order_quantity", PRICE),
    T.StructField("filled_quantity", PRICE),
    T.StructField("order_price", PRICE),
    T.StructField("exchange", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

STRATEGY = T.StructType([
    T.StructField("strategy_id", T.LongType()),
    T.StructField("number_of_currencies", T.IntegerType()),
    T.StructField("minimal_price_spread", T.DoubleType()),
    T.StructField("min_transaction_profit", T.DoubleType()),
    T.StructField("maximal_transaction_value", T.DoubleType()),
    T.StructField("maximal_trading_value", T.DoubleType()),
    T.StructField("init_investment", T.DoubleType()),
])
