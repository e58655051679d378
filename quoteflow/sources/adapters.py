"""Derive the engine's domain tables from the driver's generic tables.

The driver ships TPC-H-like tables plus an ``events`` stream; the engine works
on quotes, listings, orders and trades. Each adapter is a narrow projection
(column pruning reaches the Parquet scan) with deterministic expressions, so
the work grows with the input tables. Doubles are never rounded here: the
oracle engine rounds differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.sources.tables import epoch_ms, read_table

# Fixed exchange ids and names of the three venues (values must equal the
# reference's: 2 Bitfinex, 6 Bitstamp, 23 Kraken).

DEFAULT_PAIRS = 20


def _pair_expr(n_pairs: int) -> str:
    return f"concat('P', lpad(cast(user_id % {n_pairs} as string), 2, '0'), '-USD')"


def _exchange_expr() -> str:
    return "CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 23 END"


def quotes(spark: SparkSession, sf_dir: str, n_pairs: int = DEFAULT_PAIRS) -> DataFrame:
    """Historical quotes (decimal prices) from ``events``; ``seq`` = arrival order."""
    return quotes_frame(read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"]), n_pairs)


def quotes_frame(ev: DataFrame, n_pairs: int = DEFAULT_PAIRS) -> DataFrame:
    """``quotes`` over any events frame (batch or streaming)."""
    ev = ev.withColumn("t", epoch_ms(ev, "ts"))
    return ev.selectExpr(
        "event_id AS seq",
        "'XQ' AS ev",
        f"{_pair_expr(n_pairs)} AS pair",
        "CAST(0 AS DECIMAL(18,8)) AS lp",
        "CAST(0 AS DECIMAL(18,8)) AS ls",
        "CAST(value AS DECIMAL(18,8)) AS bp",
        "CAST(1 + event_id % 10 AS DECIMAL(18,8)) AS bs",
        "CAST(CAST(value AS DECIMAL(18,8)) + (event_id % 7) * CAST(0.05 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS ap",
        "CAST(1 + event_id % 13 AS DECIMAL(18,8)) AS `as`",
        "t",
        f"CAST({_exchange_expr()} AS INT) AS x",
        "t AS r",
    )


def live_quotes(spark: SparkSession, sf_dir: str, n_pairs: int = DEFAULT_PAIRS) -> DataFrame:
    """Live ticks (double prices) from ``events``; ``seq`` = arrival order."""
    return live_quotes_frame(read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"]), n_pairs)


def live_quotes_frame(ev: DataFrame, n_pairs: int = DEFAULT_PAIRS) -> DataFrame:
    """``live_quotes`` over any events frame (batch or streaming)."""
    ev = ev.withColumn("t", epoch_ms(ev, "ts"))
    return ev.selectExpr(
        "event_id AS seq",
        "'XQ' AS ev",
        f"{_pair_expr(n_pairs)} AS pair",
        "CAST(0 AS DOUBLE) AS lp",
        "CAST(0 AS DOUBLE) AS ls",
        "value AS bp",
        "CAST(1 + event_id % 10 AS DOUBLE) AS bs",
        "value + CAST(event_id % 7 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS ap",
        "CAST(1 + event_id % 13 AS DOUBLE) AS `as`",
        "t",
        f"CAST({_exchange_expr()} AS INT) AS x",
    )


def listing_symbols(spark: SparkSession, sf_dir: str, n_pairs: int = DEFAULT_PAIRS) -> DataFrame:
    """One listed symbol per event: venue by event_id, currencies by user_id.
    Every fifth symbol has a 4-character base (rejected by the 3+3 rule) and
    every eleventh Bitfinex symbol has no separator (also rejected)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id"])
    return ev.selectExpr(
        "event_id",
        "CASE event_id % 3 WHEN 0 THEN 'bitfinex' WHEN 1 THEN 'bitstamp' ELSE 'kraken' END AS source",
        "event_id div 64 AS fetch_id",
        f"CASE WHEN event_id % 5 = 0 THEN concat('P', lpad(cast(user_id % {n_pairs} as string), 3, '0')) "
        f"ELSE concat('P', lpad(cast(user_id % {n_pairs} as string), 2, '0')) END AS base",
        "CASE WHEN user_id % 4 = 0 THEN 'EUR' ELSE 'USD' END AS quote",
    )


def listing_payloads(spark: SparkSession, sf_dir: str, n_pairs: int = DEFAULT_PAIRS) -> DataFrame:
    """Landed listing payloads: one JSON document per (source, fetch), in the
    venue's own shape. A fetch holds at most 64 events, so building it is a
    bounded per-group collect."""
    s = listing_symbols(spark, sf_dir, n_pairs)
    s = s.withColumn(
        "symbol",
        F.expr("CASE source WHEN 'bitfinex' THEN "
               "  CASE WHEN event_id % 11 = 0 THEN concat(base, quote) ELSE concat(base, ':', quote) END "
               "ELSE concat(base, '/', quote) END"))
    g = s.groupBy("source", "fetch_id").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "symbol"))).alias("items"))
    syms = F.transform("items", lambda i: i["symbol"])
    payload = (
        F.when(F.col("source") == "bitfinex",
               F.to_json(F.when(F.col("fetch_id") % 9 == 0, F.array(syms, syms)).otherwise(F.array(syms))))
        .when(F.col("source") == "bitstamp",
              F.to_json(F.transform("items", lambda i: F.struct(i["symbol"].alias("name")))))
        .otherwise(F.to_json(F.struct(
            F.when(F.col("fetch_id") % 7 == 0, F.array(F.lit("EAPI:Rate limit exceeded")))
             .otherwise(F.array().cast("array<string>")).alias("error"),
            F.map_from_entries(F.transform(
                "items", lambda i: F.struct(
                    F.concat(F.regexp_replace(i["symbol"], "/", ""), F.lit("."), i["event_id"].cast("string")),
                    F.struct(i["symbol"].alias("wsname"))))).alias("result"))))
    )
    return g.select("source", "fetch_id", payload.alias("payload"))


def orders(spark: SparkSession, sf_dir: str, n_pairs: int = 200) -> DataFrame:
    """Order book rows from ``lineitem``: one order per line item. The order
    id needs the ship date: (orderkey, linenumber, partkey, suppkey) repeats."""
    li = read_table(spark, sf_dir, "lineitem", LINEITEM_ORDER_COLUMNS)
    return orders_frame(li, n_pairs)


ORDER_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'))"
LINEITEM_ORDER_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                          "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]


def orders_frame(li: DataFrame, n_pairs: int = 200) -> DataFrame:
    """``orders`` over any lineitem frame (batch or streaming). Quantities are
    fractional, in exact tenths: l_quantity plus l_orderkey % 10 tenths."""
    tenths = "(CAST(floor(l_quantity) AS BIGINT) * 10 + l_orderkey % 10)"
    filled = f"(CASE WHEN l_linestatus = 'F' THEN {tenths} WHEN l_returnflag = 'N' THEN 0L ELSE {tenths} div 2 END)"
    exact = "CAST(CAST({} AS DECIMAL(18,0)) * CAST('0.1' AS DECIMAL(2,1)) AS DECIMAL(18,8))".format
    return li.selectExpr(
        f"{ORDER_ID} AS order_id",
        f"concat('P', cast(l_partkey % {n_pairs} as string)) AS currency_pair",
        "CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS type",
        f"{exact(tenths)} AS order_quantity",
        f"{exact(filled)} AS filled_quantity",
        "CAST(l_extendedprice AS DECIMAL(18,8)) AS order_price",
        "CASE l_orderkey % 3 WHEN 0 THEN 'Bitfinex' WHEN 1 THEN 'Kraken' ELSE 'Bitstamp' END AS exchange",
        f"CASE WHEN {filled} >= {tenths} THEN 'FullyFilled' WHEN {filled} = 0 THEN 'NotFilled' "
        "ELSE 'PartiallyFulfilled' END AS status",
        "cast(l_orderkey as string) AS transaction_id",
        "l_linenumber AS attempt",
        "l_shipdate AS ts",
    )


def fill_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order-status payloads as each venue returns them (three JSON shapes),
    keyed by (exchange, order_id). By transaction id, some orders have no report
    (0 modulo 89), some an error reply (1) and some a cut-off one (2)."""
    o = orders(spark, sf_dir)
    sym = F.regexp_replace("currency_pair", "-", "")
    signed = F.when(F.col("type") == "sell", -F.col("filled_quantity")).otherwise(F.col("filled_quantity"))
    rest = F.col("transaction_id").cast("bigint") % 89
    payload = (
        F.when(rest == 1, F.lit('{"error":["EGeneral:Internal error"]}'))
        .when(rest == 2, F.lit('[[12,0,'))
        .when(F.col("exchange") == "Bitfinex",
               F.format_string('[[%s,0,0,"t%s",%s]]', F.col("transaction_id"), sym,
                               signed.cast("string")))
        .when(F.col("exchange") == "Kraken",
              F.format_string('{"error":[],"result":{"%s":{"status":"closed","vol_exec":"%s"}}}',
                              F.col("order_id"), F.col("filled_quantity").cast("string")))
        .otherwise(F.format_string('{"id":"%s","status":"Finished","amount_remaining":"%s"}',
                                   F.col("order_id"),
                                   (F.col("order_quantity") - F.col("filled_quantity")).cast("string")))
    )
    return o.where(rest != 0).select("exchange", "order_id", payload.alias("payload"))


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One portfolio per customer: investment = account balance, P&L from the
    customer's orders (exact decimal sum), duration from first to last order. Customers without
    orders have not started; every 50th has no investment."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    per = o.groupBy("o_custkey").agg(
        F.sum(F.expr("CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) "
                     "ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END")).alias("pnl_cents"),
        F.min(F.to_date("o_orderdate")).alias("start_date"),
        F.max(F.to_date("o_orderdate")).alias("end_date"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").selectExpr(
        "c_custkey AS portfolio_id",
        "CASE WHEN c_custkey % 50 <> 0 THEN c_acctbal END AS init_invest",
        "CAST(pnl_cents AS DOUBLE) / CAST(100 AS DOUBLE) AS cum_pnl",
        "start_date",
        "end_date",
    )


def threshold_commands(spark: SparkSession, sf_dir: str, scale: float = 1000.0) -> DataFrame:
    """P&L threshold commands from ``orders``: a positive threshold, a clear (0)
    or an invalid negative value, by order status."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    return o.selectExpr(
        "o_orderkey AS command_id",
        "o_orderdate AS ts",
        f"CAST(CASE o_orderstatus WHEN 'P' THEN -o_totalprice WHEN 'O' THEN 0 "
        f"ELSE o_totalprice * {scale} END AS DECIMAL(18,2)) AS threshold",
    )


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy submissions from ``part``; some violate each validation rule."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_retailprice"])
    return p.selectExpr(
        "p_partkey AS strategy_id",
        "CAST(p_size % 7 - 1 AS INT) AS number_of_currencies",
        "CAST(p_size - 3 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS minimal_price_spread",
        "p_retailprice / CAST(100 AS DOUBLE) AS min_transaction_profit",
        "p_retailprice - CAST(920 AS DOUBLE) AS maximal_transaction_value",
        "p_retailprice * CAST(p_size % 5 - 1 AS DOUBLE) AS maximal_trading_value",
        "p_retailprice * CAST(10 AS DOUBLE) - CAST(9300 AS DOUBLE) AS init_investment",
    )


def parameter_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated trading parameters from every third ``nation``, spread over the ticks; some stop trading."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"]).where("n_nationkey % 3 = 0")
    ticks = read_table(spark, sf_dir, "events", ["event_id"]).agg((F.max("event_id") + 1).alias("n_ticks"))
    # both sides are a few rows: 25 nations and one count
    return n.join(F.broadcast(ticks)).selectExpr(
        "CAST(n_nationkey * n_ticks div 25 + 37 AS BIGINT) AS effective_seq",
        "CAST(2 + n_regionkey AS DOUBLE) AS min_spread",
        "CAST(4 + 2 * n_regionkey AS DOUBLE) AS min_profit",
        "CAST(900 AS DOUBLE) AS max_transaction_value",
        "CAST(1500 + 700 * n_nationkey AS DOUBLE) AS max_trading_value",
        "n_nationkey % 9 <> 6 AS trading_active")


def transaction_status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates for transactions (keyed like the order lines' orderkey)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    return o.selectExpr(
        "cast(o_orderkey as string) AS transaction_id",
        "CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Submitted' "
        "ELSE 'PartiallyFulfilled' END AS new_status")


def transaction_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates of transactions over time, one per order line (``updated_at``, then ``line``, orders those of one
    transaction); line numbers of 7 name transactions that are not stored."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return li.selectExpr(
        "CASE WHEN l_linenumber = 7 THEN concat('x', l_orderkey) ELSE cast(l_orderkey as string) END AS transaction_id",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) AS updated_at",
        "concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS line",
        "CASE (l_partkey + l_suppkey) % 3 WHEN 0 THEN 'Fulfilled' WHEN 1 THEN 'Submitted' "
        "ELSE 'PartiallyFulfilled' END AS new_status")


def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ids to look up: those of every fifth order key, a 13th of them under another name."""
    o = orders(spark, sf_dir).where("cast(transaction_id as bigint) % 5 = 0")
    return o.selectExpr("CASE WHEN cast(transaction_id as bigint) % 13 = 0 THEN concat('x', order_id) ELSE order_id END AS order_id")


def reported_id(order_id: str):
    """The order that a venue's report names: for some order keys one that is not stored."""
    key = F.split(F.col(order_id), "-")[0].cast("bigint")
    return F.when(key % 97 == 5, F.concat(F.lit("x"), F.col(order_id))).otherwise(F.col(order_id))


def submit_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The venues' replies to submitted orders (three JSON shapes); by transaction id some are errors (0 modulo
    71) or cut off (1)."""
    o = orders(spark, sf_dir).select("exchange", "order_id", "transaction_id")
    rest, given = F.col("transaction_id").cast("bigint") % 71, F.concat(F.lit("V"), F.col("order_id"))
    payload = (F.when(rest == 0, F.lit('{"error":["EOrder:Insufficient funds"]}'))
               .when(rest == 1, F.lit('[0,"on-req",'))
               .when(F.col("exchange") == "Bitfinex", F.format_string('[0,"on-req",null,null,[["%s",null,0]],null,"SUCCESS"]', given))
               .when(F.col("exchange") == "Kraken", F.format_string('{"error":[],"result":{"txid":["%s"]}}', given))
               .otherwise(F.format_string('{"id":"%s","type":"0"}', given)))
    return o.select("exchange", "order_id", payload.alias("payload"))


def period_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of a month from each order's date, as text in several forms; every seventh has no end date."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    return o.selectExpr(
        "o_orderkey AS request_id",
        "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS start",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'next month' ELSE date_format(o_orderdate + INTERVAL 30 DAYS, 'yyyy-MM-dd') END AS end")


def unlisted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``live_quotes`` where every 41st tick comes from a venue that is not supported."""
    q = live_quotes(spark, sf_dir)
    return q.withColumn("x", F.when(F.col("seq") % 41 == 0, F.lit(99)).otherwise(F.col("x")))


def gate_closing(spark: SparkSession, sf_dir: str) -> int | None:
    """When the P&L gate closes: a 200th into the ticks' time, in epoch ms."""
    ev = read_table(spark, sf_dir, "events", ["ts"])
    return ev.select(epoch_ms(ev, "ts").alias("t")).agg(F.expr("(min(t) * 199 + max(t)) div 200").alias("m")).first()["m"]
