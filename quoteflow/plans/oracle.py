"""Independent DuckDB SQL for each registered query.

Written directly from the reference's semantics (literal self-joins, window
ranks, as-of joins), not from the Spark plans, so agreement is evidence.
The fixture CTEs restate the adapters of ``quoteflow.sources.adapters``.
"""

from __future__ import annotations

# ------------------------------------------------------------------ fixtures
QUOTES = """
quotes AS (
  SELECT event_id AS seq,
         'P' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') || '-USD' AS pair,
         CAST(value AS DECIMAL(18,8)) AS bp,
         CAST(CAST(value AS DECIMAL(18,8)) + (event_id % 7) * CAST(0.05 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS ap,
         epoch_us(ts) // 1000 AS t,
         CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 23 END AS x
  FROM events
)"""

HIST = QUOTES + """,
hq AS (SELECT *, t // 21600000 AS bucket FROM quotes),
reps AS (
  SELECT bucket, pair, x, n_quotes, bp, ap, seq AS best_seq FROM (
    SELECT *, count(*) OVER (PARTITION BY bucket, pair, x) AS n_quotes,
           row_number() OVER (PARTITION BY bucket, pair, x ORDER BY bp DESC, seq ASC) AS rn
    FROM hq) WHERE rn = 1
),
grp AS (
  SELECT bucket, pair, min(seq) AS pair_first FROM hq GROUP BY bucket, pair HAVING count(*) > 1
),
bfirst AS (SELECT bucket, min(seq) AS bucket_first FROM hq GROUP BY bucket),
crossed AS (
  SELECT DISTINCT r1.bucket, r1.pair FROM reps r1 JOIN reps r2
    ON r1.bucket = r2.bucket AND r1.pair = r2.pair
  WHERE r1.bp - r2.ap > 0.01
),
flags AS (
  SELECT g.bucket, g.pair, g.pair_first, b.bucket_first,
         CASE WHEN c.pair IS NULL THEN 0 ELSE 1 END AS f
  FROM grp g JOIN bfirst b USING (bucket)
  LEFT JOIN crossed c ON c.bucket = g.bucket AND c.pair = g.pair
),
hist_counts AS (
  SELECT pair, CAST(sum(f) AS BIGINT) AS opportunities,
         arg_min(bucket_first, bucket_first) AS order_bucket_seq,
         arg_min(pair_first, bucket_first) AS order_pair_seq
  FROM flags GROUP BY pair HAVING sum(f) <> 0
)"""

ORACLE: dict[str, str] = {}

ORACLE["hist_best_quotes"] = "WITH " + HIST + """
SELECT bucket, pair, x, n_quotes, bp, ap, best_seq FROM reps"""

ORACLE["hist_opportunities"] = "WITH " + HIST + """
SELECT pair, opportunities, order_bucket_seq, order_pair_seq FROM hist_counts"""

ORACLE["hist_report"] = "WITH " + HIST + """
SELECT pair, opportunities, printf('%s, %d opportunities', pair, opportunities) AS line FROM hist_counts"""

LISTINGS = """
sym AS (
  SELECT event_id,
         CASE event_id % 3 WHEN 0 THEN 'bitfinex' WHEN 1 THEN 'bitstamp' ELSE 'kraken' END AS source,
         event_id // 64 AS fetch_id,
         CASE WHEN event_id % 5 = 0 THEN 'P' || lpad(CAST(user_id % 20 AS VARCHAR), 3, '0')
              ELSE 'P' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') END AS base,
         CASE WHEN user_id % 4 = 0 THEN 'EUR' ELSE 'USD' END AS quote
  FROM events
),
listings AS (
  SELECT source, fetch_id, base AS currency1, quote AS currency2 FROM sym
  WHERE length(base) = 3 AND length(quote) = 3
    AND NOT (source = 'bitfinex' AND (event_id % 11 = 0 OR fetch_id % 9 = 0))
    AND NOT (source = 'kraken' AND fetch_id % 7 = 0)
),
complete_fetches AS (
  SELECT fetch_id FROM sym GROUP BY fetch_id HAVING count(DISTINCT source) = 3
),
cross_pairs AS (
  SELECT currency1, currency2, currency1 || '-' || currency2 AS pair,
         max(n) AS n_listings, max(nx) AS n_exchanges
  FROM (SELECT fetch_id, currency1, currency2, count(*) AS n, count(DISTINCT source) AS nx
        FROM listings WHERE fetch_id IN (SELECT fetch_id FROM complete_fetches)
        GROUP BY fetch_id, currency1, currency2 HAVING count(*) > 1)
  GROUP BY currency1, currency2
)"""

ORACLE["listing_pairs"] = "WITH " + LISTINGS + """
SELECT source, fetch_id, currency1, currency2 FROM listings"""

ORACLE["cross_traded_pairs"] = "WITH " + LISTINGS + """
SELECT currency1, currency2, pair, n_listings, n_exchanges FROM cross_pairs"""

ORACLE["pairs_to_track"] = "WITH " + HIST + "," + LISTINGS + """
SELECT row_number() OVER (ORDER BY order_bucket_seq, order_pair_seq) AS rank, pair, opportunities
FROM hist_counts WHERE pair IN (SELECT pair FROM cross_pairs)
ORDER BY order_bucket_seq, order_pair_seq LIMIT 5"""

LIVE_TEMPLATE = """
ticks AS (
  SELECT event_id AS seq,
         'P' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') || '-USD' AS pair,
         value AS bp,
         CAST(1 + event_id % 10 AS DOUBLE) AS bs,
         value + CAST(event_id % 7 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS ap,
         CAST(1 + event_id % 13 AS DOUBLE) AS "as",
         CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 23 END AS x
  FROM events{tick_where}
),
px AS (SELECT DISTINCT pair, x FROM ticks),
grid AS (SELECT t.pair, t.seq, px.x FROM ticks t JOIN px ON t.pair = px.pair),
latest AS (
  SELECT g.pair, g.seq, g.x, q.seq AS q_seq, q.bp, q.bs, q.ap, q."as"
  FROM grid g ASOF JOIN ticks q ON g.pair = q.pair AND g.x = q.x AND g.seq >= q.seq
),
opps AS (
  SELECT b.pair, b.seq, b.x AS buy_x, s.x AS sell_x, b.ap AS buy_price, s.bp AS sell_price,
         least(b."as", s.bs) AS quantity, (s.bp - b.ap) * least(b."as", s.bs) AS profit
  FROM latest b JOIN latest s ON b.pair = s.pair AND b.seq = s.seq AND b.x <> s.x
  WHERE s.bp - b.ap >= CAST(5 AS DOUBLE)
    AND (s.bp - b.ap) * least(b."as", s.bs) >= CAST(10 AS DOUBLE)
    AND b.ap * least(b."as", s.bs) <= CAST(900 AS DOUBLE)
),
best AS (
  SELECT pair, seq, buy_x, sell_x, buy_price, sell_price, quantity, profit FROM (
    SELECT *, row_number() OVER (PARTITION BY pair, seq
                                 ORDER BY profit DESC, CAST(buy_x AS VARCHAR), CAST(sell_x AS VARCHAR)) AS rn
    FROM opps) WHERE rn = 1
),
firsts AS (
  SELECT *, CAST(buy_price * quantity AS DECIMAL(38,10)) AS value_dec FROM (
    SELECT *, row_number() OVER (PARTITION BY pair, buy_x, sell_x ORDER BY seq) AS rk
    FROM best WHERE quantity > 0) WHERE rk = 1
),
budget AS (
  SELECT *, CAST(prior_dec AS DOUBLE) AS prior_value FROM (
    SELECT *, coalesce(sum(value_dec) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                       0) AS prior_dec
    FROM firsts)
),
executed AS (
  SELECT *, CASE WHEN prior_dec + value_dec > 4000
                 THEN (CAST(4000 AS DOUBLE) - prior_value) / buy_price ELSE quantity END AS final_qty
  FROM budget
)"""

LIVE = LIVE_TEMPLATE.replace("{tick_where}", "")

EXCHANGE_NAME_SQL = ("CASE {c} WHEN 6 THEN 'Bitstamp' WHEN 23 THEN 'Kraken' WHEN 2 THEN 'Bitfinex' "
                     "ELSE 'Exchange' || CAST({c} AS VARCHAR) END")

ORACLE["latest_quote_grid"] = "WITH " + LIVE + """
SELECT pair, seq, x, q_seq, bp, bs, ap, "as" FROM latest"""

ORACLE["opportunities"] = "WITH " + LIVE + """
SELECT * FROM opps"""

ORACLE["best_opportunity"] = "WITH " + LIVE + """
SELECT * FROM best"""

ORACLE["executed_opportunities"] = "WITH " + LIVE + f"""
SELECT pair, seq, buy_x, sell_x,
       {EXCHANGE_NAME_SQL.format(c='buy_x')} AS buy_exchange,
       {EXCHANGE_NAME_SQL.format(c='sell_x')} AS sell_exchange,
       buy_price, sell_price, final_qty AS quantity, buy_price * final_qty AS value, prior_value
FROM executed WHERE final_qty > 0"""

ORDERS = """
orders_fx AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS order_id,
         'P' || CAST(l_partkey % 200 AS VARCHAR) AS currency_pair,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS type,
         CAST(CAST(tq AS DECIMAL(18,0)) * CAST('0.1' AS DECIMAL(2,1)) AS DECIMAL(18,8)) AS order_quantity,
         CAST(CAST(fq AS DECIMAL(18,0)) * CAST('0.1' AS DECIMAL(2,1)) AS DECIMAL(18,8)) AS filled_quantity,
         CAST(l_extendedprice AS DECIMAL(18,8)) AS order_price,
         CASE l_orderkey % 3 WHEN 0 THEN 'Bitfinex' WHEN 1 THEN 'Kraken' ELSE 'Bitstamp' END AS exchange,
         CASE WHEN fq >= tq THEN 'FullyFilled' WHEN fq = 0 THEN 'NotFilled'
              ELSE 'PartiallyFulfilled' END AS status,
         CAST(l_orderkey AS VARCHAR) AS transaction_id,
         l_linenumber AS attempt,
         l_shipdate AS ts
  FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN tq WHEN l_returnflag = 'N' THEN 0 ELSE tq // 2 END AS fq
        FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) * 10 + l_orderkey % 10 AS tq FROM lineitem))
)"""


def fold_sql(prefix: str, where: str, leaf: int = 4096, fan: int = 256) -> str:
    """Recursive-CTE restatement of the weighted-average-cost fold, one step
    per trade per pair. The cost after a leaf of trades is a * (the leaf's entry cost) + b, after
    ``fan`` leaves that of their composed maps; nodes of nodes (pairs of over leaf * fan * fan trades) are left out."""
    taken = "f.has AND f.q >= n.amount"
    leaf_ends, node_ends = f"f.rn > 0 AND f.rn % {leaf} = 0", f"f.rn > 0 AND f.rn % {leaf * fan} = 0"
    mean = lambda c: (
        f"(CAST(f.q AS DOUBLE) * {c} + CAST(n.amount AS DOUBLE) * n.price) / CAST(f.q + n.amount AS DOUBLE)")
    after = lambda c: (
        f"CASE WHEN n.side = 'buy' THEN CASE WHEN f.q + n.amount > 0 THEN {mean(c)} ELSE 0 END "
        f"WHEN {taken} THEN CASE WHEN f.q - n.amount > 0 THEN {c} ELSE 0 END ELSE {c} END")
    return f"""
{prefix}_trades AS (
  SELECT currency_pair AS pair, order_id, type AS side, CAST(filled_quantity AS DECIMAL(38,8)) AS amount,
         CAST(order_price AS DOUBLE) AS price, ts,
         row_number() OVER (PARTITION BY currency_pair ORDER BY ts, order_id, type, filled_quantity, order_price) AS rn
  FROM orders_fx WHERE {where}
),
{prefix}_fold(pair, rn, q, c, has, delta, c0, a, b, c1, a1, b1) AS (
  SELECT pair, CAST(0 AS BIGINT), CAST(0 AS DECIMAL(38,8)), CAST(0 AS DOUBLE), false, CAST(0 AS DOUBLE),
         CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)
  FROM (SELECT DISTINCT pair FROM {prefix}_trades)
  UNION ALL
  SELECT n.pair, n.rn,
    CASE WHEN n.side = 'buy' THEN f.q + n.amount
         WHEN {taken} THEN CASE WHEN f.q - n.amount > 0 THEN f.q - n.amount ELSE 0 END
         ELSE f.q END,
    {after("f.c")},
    CASE WHEN n.side = 'buy' THEN true
         WHEN {taken} THEN f.q - n.amount > 0
         ELSE f.has END,
    CASE WHEN n.side = 'buy' THEN 0
         WHEN {taken} THEN (n.price - f.c) * CAST(n.amount AS DOUBLE)
         WHEN f.has THEN 0
         ELSE n.price * CAST(n.amount AS DOUBLE) END,
    f.c0,
    CASE WHEN n.side = 'buy' THEN CASE WHEN f.q + n.amount > 0
              THEN f.a * (CAST(f.q * 100000000 AS DOUBLE) / CAST((f.q + n.amount) * 100000000 AS DOUBLE)) ELSE 0 END
         WHEN {taken} THEN CASE WHEN f.q - n.amount > 0 THEN f.a ELSE 0 END ELSE f.a END,
    {after("f.b")},
    f.c1, f.a1, f.b1
  FROM (
    SELECT pair, rn, q, CASE WHEN {node_ends} THEN a1 * c1 + b1 WHEN {leaf_ends} THEN c_leaf ELSE c END AS c, has,
           CASE WHEN {node_ends} THEN a1 * c1 + b1 WHEN {leaf_ends} THEN c_leaf ELSE c0 END AS c0,
           CASE WHEN {leaf_ends} THEN 1 ELSE a END AS a, CASE WHEN {leaf_ends} THEN 0 ELSE b END AS b,
           CASE WHEN {node_ends} THEN a1 * c1 + b1 ELSE c1 END AS c1,
           CASE WHEN {node_ends} THEN 1 ELSE a1 END AS a1, CASE WHEN {node_ends} THEN 0 ELSE b1 END AS b1
    FROM (SELECT pair, rn, q, c, has, c0, a, b, c1, a * c0 + b AS c_leaf,
                 CASE WHEN {leaf_ends} THEN a * a1 ELSE a1 END AS a1,
                 CASE WHEN {leaf_ends} THEN a * b1 + b ELSE b1 END AS b1 FROM {prefix}_fold f) f
  ) f JOIN {prefix}_trades n ON n.pair = f.pair AND n.rn = f.rn + 1
),
{prefix}_folded AS (
  SELECT n.pair, n.order_id, n.ts, n.side, n.rn, f.delta, CAST(f.q AS DOUBLE) AS quantity, f.c AS avg_cost,
         f.has AS has_position, CAST(f.delta AS DECIMAL(38,6)) AS pnl
  FROM {prefix}_fold f JOIN {prefix}_trades n ON n.pair = f.pair AND n.rn = f.rn
  WHERE f.rn > 0
)"""


LIVE_FOLD = ORDERS + "," + fold_sql("live", "status IN ('FullyFilled', 'PartiallyFulfilled')")

PAIR_PNL = """
pair_pnl AS (
  SELECT pair, sum(pnl) AS realized_pnl, count(*) AS n_trades,
         arg_max(quantity, rn) AS quantity, arg_max(avg_cost, rn) AS avg_cost,
         arg_max(has_position, rn) AS has_position
  FROM live_folded GROUP BY pair
)"""

ORACLE["pnl_by_pair"] = "WITH RECURSIVE " + LIVE_FOLD + "," + PAIR_PNL + """
SELECT * FROM pair_pnl"""

ORACLE["inventory"] = "WITH RECURSIVE " + LIVE_FOLD + "," + PAIR_PNL + """
SELECT pair, quantity, avg_cost FROM pair_pnl WHERE has_position"""

ORACLE["historical_pnl"] = "WITH RECURSIVE " + ORDERS + "," + fold_sql(
    "hist", "status = 'FullyFilled' AND ts >= TIMESTAMP '1996-01-01 00:00:00' "
            "AND ts <= TIMESTAMP '1999-12-31 00:00:00'") + """
SELECT coalesce(sum(pnl), CAST(0 AS DECIMAL(38,6))) AS total_pnl, count(*) AS n_trades FROM hist_folded"""

CUM = """
cum AS (
  SELECT ts, order_id, pair, pnl,
         sum(pnl) OVER (ORDER BY ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pnl
  FROM live_folded
)"""

ORACLE["cumulative_pnl"] = "WITH RECURSIVE " + LIVE_FOLD + "," + CUM + """
SELECT * FROM cum"""

THRESHOLD_CTES = "WITH RECURSIVE " + LIVE_FOLD + "," + CUM + """,
cmds AS (
  SELECT o_orderkey AS command_id, o_orderdate AS ts,
         CAST(CASE o_orderstatus WHEN 'P' THEN -o_totalprice WHEN 'O' THEN 0
                   ELSE o_totalprice * 1000 END AS DECIMAL(18,2)) AS threshold
  FROM orders
),
st AS (
  SELECT *, CASE WHEN threshold < 0 THEN 'error: Threshold must be non-negative'
                 WHEN threshold = 0 THEN 'cleared' ELSE 'set' END AS status
  FROM cmds
),
eff AS (
  SELECT ts, max(command_id) AS command_id, arg_max(threshold, command_id) AS threshold
  FROM st WHERE threshold >= 0 GROUP BY ts
),
effn AS (SELECT *, lead(ts) OVER (ORDER BY ts) AS next_ts FROM eff),
hits AS (
  SELECT command_id, alert_ts, alert_order_id, alert_cum_pnl FROM (
    SELECT e.command_id, c.ts AS alert_ts, c.order_id AS alert_order_id, c.cum_pnl AS alert_cum_pnl,
           row_number() OVER (PARTITION BY e.command_id ORDER BY c.ts, c.order_id) AS rn
    FROM effn e JOIN cum c
      ON c.ts >= e.ts AND (e.next_ts IS NULL OR c.ts < e.next_ts) AND c.cum_pnl >= e.threshold
    WHERE e.threshold > 0) WHERE rn = 1
)"""

ORACLE["threshold_alert"] = THRESHOLD_CTES + """
SELECT st.command_id, st.ts, st.threshold, st.status, h.alert_ts, h.alert_order_id, h.alert_cum_pnl
FROM st LEFT JOIN hits h USING (command_id)"""

ORACLE["annualized_return"] = """
WITH per AS (
  SELECT o_custkey,
         sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2))
                  ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END) AS pnl_cents,
         min(CAST(o_orderdate AS DATE)) AS start_date, max(CAST(o_orderdate AS DATE)) AS end_date
  FROM orders GROUP BY o_custkey
),
p AS (
  SELECT c_custkey AS portfolio_id, CASE WHEN c_custkey % 50 <> 0 THEN c_acctbal END AS init_invest,
         coalesce(CAST(pnl_cents AS DOUBLE) / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE)) AS cum_pnl, start_date,
         CAST(date_diff('day', start_date, end_date) AS DOUBLE) / CAST(365 AS DOUBLE) AS years
  FROM customer LEFT JOIN per ON c_custkey = o_custkey
),
v AS (
  SELECT *, CASE WHEN init_invest IS NULL THEN 'Initial investment amount not set'
                 WHEN start_date IS NULL THEN 'Trading has not been started yet'
                 WHEN cum_pnl < 0 THEN 'PNL should be non-negative'
                 WHEN init_invest <= 0 THEN 'Initial investment should be larger than 0'
                 WHEN years <= 0 THEN 'Duration of Year should be larger than 0' END AS error
  FROM p
)
SELECT portfolio_id, init_invest, cum_pnl, years, error,
       CASE WHEN error IS NULL
            THEN round(pow(cum_pnl / init_invest, CAST(1 AS DOUBLE) / years) - CAST(1 AS DOUBLE), 10) END
         AS annualized_return
FROM v"""

SYMBOL_SQL = ("CASE {e} WHEN 'Bitfinex' THEN 't' || replace({p}, '-', '') "
              "WHEN 'Kraken' THEN 'XX' || replace({p}, '-', '') "
              "WHEN 'Bitstamp' THEN lower(replace({p}, '-', '')) END")


def _leg(side: str, ex_col: str, price: str, closed: str = "false") -> str:
    ex = EXCHANGE_NAME_SQL.format(c=ex_col)
    signed = f"CASE WHEN {ex_col} = 2 THEN -final_qty ELSE final_qty END" if side == "sell" else "final_qty"
    return f"""
SELECT sha256(pair || ':' || CAST(buy_x AS VARCHAR) || '->' || CAST(sell_x AS VARCHAR) || '@' || CAST(seq AS VARCHAR))
         AS transaction_id,
       pair, seq, '{side}' AS type, {ex} AS exchange, {price} AS order_price, final_qty AS order_quantity,
       'Pending' AS status, {SYMBOL_SQL.format(e=ex, p='pair')} AS symbol, {signed} AS signed_amount,
       CASE WHEN {closed} THEN 'Trading is stopped due to P&L threshold reached.'
            WHEN {ex_col} NOT IN (2, 6, 23) THEN 'Exchange not supported' END AS error
FROM executed WHERE final_qty > 0"""


ORACLE["order_legs"] = "WITH " + LIVE + _leg("buy", "buy_x", "buy_price") + " UNION ALL " + _leg(
    "sell", "sell_x", "sell_price")

_CLOSED = ("(SELECT epoch_us(ts) // 1000 FROM events v WHERE v.event_id = executed.seq)"
           " >= (SELECT (min(epoch_us(ts) // 1000) * 199 + max(epoch_us(ts) // 1000)) // 200 FROM events)")
ORACLE["gated_order_legs"] = ("WITH " + LIVE.replace(
    "CASE event_id % 3 WHEN 0", "CASE WHEN event_id % 41 = 0 THEN 99 ELSE CASE event_id % 3 WHEN 0").replace(
    "ELSE 23 END AS x", "ELSE 23 END END AS x") + _leg("buy", "buy_x", "buy_price", _CLOSED) + " UNION ALL "
    + _leg("sell", "sell_x", "sell_price", _CLOSED))

ORACLE["fill_amounts"] = "WITH " + ORDERS + """
SELECT order_id, exchange, order_quantity,
       CASE WHEN CAST(transaction_id AS BIGINT) % 89 > 2 THEN filled_quantity END AS filled,
       CAST(transaction_id AS BIGINT) % 89 <> 0 AS has_report FROM orders_fx"""

ORACLE["fill_status"] = "WITH " + ORDERS + """
SELECT order_id, exchange, order_quantity,
       CASE WHEN CAST(transaction_id AS BIGINT) % 89 > 2 THEN filled_quantity END AS filled,
       CASE WHEN CAST(transaction_id AS BIGINT) % 89 > 2 THEN status ELSE 'Unreadable' END AS status
FROM orders_fx WHERE CAST(transaction_id AS BIGINT) % 89 <> 0"""

ORACLE["order_chain"] = "WITH " + ORDERS + """,
a1 AS (
  SELECT transaction_id, type, attempt, order_id, filled_quantity,
         first_value(order_quantity) OVER (PARTITION BY transaction_id, type ORDER BY attempt, order_id) AS initial,
         coalesce(sum(filled_quantity) OVER (PARTITION BY transaction_id, type ORDER BY attempt, order_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_fill
  FROM orders_fx
),
a2 AS (
  SELECT *, initial - prior_fill AS requested,
         CASE WHEN filled_quantity >= initial - prior_fill THEN 'FullyFilled'
              WHEN filled_quantity = 0 THEN 'NotFilled' ELSE 'PartiallyFulfilled' END AS status
  FROM a1
),
a3 AS (
  SELECT *, coalesce(sum(CASE WHEN status <> 'PartiallyFulfilled' THEN 1 ELSE 0 END)
              OVER (PARTITION BY transaction_id, type ORDER BY attempt, order_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops_before
  FROM a2
)
SELECT transaction_id, type, count(*) AS attempts, max(initial) AS initial_quantity,
       CAST(sum(filled_quantity) AS DECIMAL(18,8)) AS total_filled,
       arg_max(status, (attempt, order_id)) AS final_status,
       CAST(arg_max(requested - filled_quantity, (attempt, order_id)) AS DECIMAL(18,8)) AS remaining
FROM a3 WHERE stops_before = 0 GROUP BY transaction_id, type"""

ORACLE["latest_orders"] = "WITH " + ORDERS + """,
told AS (
  SELECT *, CAST(transaction_id AS BIGINT) % 97 = 5 AS stray FROM orders_fx WHERE CAST(transaction_id AS BIGINT) % 89 > 2
),
hits AS (SELECT order_id, max(status) AS status, max(filled_quantity) AS filled_quantity FROM told WHERE NOT stray GROUP BY order_id)
SELECT o.order_id, CAST(CASE WHEN h.order_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version,
       coalesce(h.status, 'Pending') AS status, coalesce(h.filled_quantity, CAST(0 AS DECIMAL(18,8))) AS filled_quantity,
       CASE WHEN h.order_id IS NOT NULL THEN 'Success' END AS result
FROM (SELECT DISTINCT order_id FROM orders_fx) o LEFT JOIN hits h USING (order_id)
UNION ALL
SELECT 'x' || order_id, 1, status, filled_quantity, 'No order updated' FROM told WHERE stray"""

ORACLE["order_log"] = ORACLE["latest_orders"]

ORACLE["submitted_orders"] = "WITH " + ORDERS + """
SELECT order_id, CASE WHEN CAST(transaction_id AS BIGINT) % 71 > 1 THEN 'V' || order_id END AS venue_order_id FROM orders_fx"""

ORACLE["period_requests"] = """
SELECT o_orderkey AS request_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS start_ts,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(date_trunc('day', o_orderdate) + INTERVAL 30 DAY AS TIMESTAMP) END AS end_ts,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Invalid dates provided' END AS error
FROM orders"""

STRATEGIES = """
strat AS (
  SELECT p_partkey AS strategy_id,
         CAST(p_size % 7 - 1 AS INTEGER) AS number_of_currencies,
         CAST(p_size - 3 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS minimal_price_spread,
         p_retailprice / CAST(100 AS DOUBLE) AS min_transaction_profit,
         p_retailprice - CAST(920 AS DOUBLE) AS maximal_transaction_value,
         p_retailprice * CAST(p_size % 5 - 1 AS DOUBLE) AS maximal_trading_value,
         p_retailprice * CAST(10 AS DOUBLE) - CAST(9300 AS DOUBLE) AS init_investment
  FROM part
),
checked AS (
  SELECT *, CASE
      WHEN number_of_currencies <= 0 THEN 'NumberOfCurrencies must be greater than zero'
      WHEN minimal_price_spread <= 0 THEN 'MinimalPriceSpread must be greater than zero'
      WHEN maximal_transaction_value <= 0 THEN 'MaximalTransactionValue must be greater than zero'
      WHEN maximal_trading_value <= 0 THEN 'MaximalTradingValue must be greater than zero'
      WHEN init_investment <= 0 THEN 'InitialInvestmentAmount must be greater than zero'
      WHEN maximal_transaction_value < minimal_price_spread
        THEN 'MaximalTransactionValue must be greater than or equal to MinimalPriceSpread'
    END AS error
  FROM strat
)"""

ORACLE["strategy_validation"] = "WITH " + STRATEGIES + """
SELECT strategy_id, error, error IS NULL AS valid FROM checked"""

ORACLE["current_strategy"] = "WITH " + STRATEGIES + """
SELECT strategy_id, number_of_currencies, minimal_price_spread, min_transaction_profit,
       maximal_transaction_value, maximal_trading_value, init_investment
FROM checked WHERE error IS NULL ORDER BY strategy_id DESC LIMIT 1"""

ORACLE["transaction_history"] = "WITH " + ORDERS + """,
tx AS (
  SELECT transaction_id, min(ts) AS first_ts, max(ts) AS last_ts,
         string_agg(order_id, ',' ORDER BY attempt DESC, order_id DESC) AS order_ids,
         count(*) AS n, count(*) FILTER (WHERE status = 'FullyFilled') AS n_full,
         count(*) FILTER (WHERE status = 'NotFilled') AS n_none
  FROM orders_fx GROUP BY transaction_id
)
SELECT transaction_id, 1 AS version, 'Submitted' AS status, order_ids, first_ts AS valid_from, last_ts AS valid_to
FROM tx
UNION ALL
SELECT transaction_id, 2, CASE WHEN n_full = n THEN 'Fulfilled' WHEN n_none = n THEN 'Cancelled'
                              ELSE 'PartiallyFulfilled' END,
       order_ids, last_ts, NULL
FROM tx"""

# Streaming forms: same results as their batch queries.
ORACLE["stream_latest_quote_grid"] = ORACLE["latest_quote_grid"]
ORACLE["stream_executed_opportunities"] = ORACLE["executed_opportunities"]
ORACLE["stream_pnl_by_pair"] = ORACLE["pnl_by_pair"]

ORACLE["quote_frames"] = """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq,
       'XQ' AS ev,
       'P' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') || '-USD' AS pair,
       value AS bp,
       CAST(1 + event_id % 10 AS DOUBLE) AS bs,
       value + CAST(event_id % 7 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS ap,
       CAST(1 + event_id % 13 AS DOUBLE) AS "as",
       epoch_us(ts) // 1000 AS t,
       CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 23 END AS x
FROM events"""

TRACKED_WHERE = (" WHERE 'P' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') || '-USD'"
                 " IN (SELECT pair FROM tracked)")

# Start trading: thresholds, budget and number of pairs are those of the current strategy.
STRATEGY_LIVE = LIVE_TEMPLATE.replace("{tick_where}", TRACKED_WHERE)
for _fixed, _from in (("CAST(5 AS DOUBLE)", "(SELECT minimal_price_spread FROM cur)"),
                      ("CAST(10 AS DOUBLE)", "(SELECT min_transaction_profit FROM cur)"),
                      ("CAST(900 AS DOUBLE)", "(SELECT maximal_transaction_value FROM cur)"),
                      ("> 4000", "> CAST((SELECT maximal_trading_value FROM cur) AS DECIMAL(38,10))"),
                      ("CAST(4000 AS DOUBLE)", "(SELECT maximal_trading_value FROM cur)")):
    STRATEGY_LIVE = STRATEGY_LIVE.replace(_fixed, _from)

ORACLE["tracked_executions"] = "WITH " + HIST + "," + LISTINGS + "," + STRATEGIES + """,
cur AS (SELECT * FROM checked WHERE error IS NULL ORDER BY strategy_id DESC LIMIT 1),
tracked AS (
  SELECT pair FROM hist_counts WHERE pair IN (SELECT pair FROM cross_pairs)
  ORDER BY order_bucket_seq, order_pair_seq LIMIT (SELECT coalesce(max(number_of_currencies), 0) FROM cur)
),""" + STRATEGY_LIVE + f"""
SELECT pair, seq, buy_x, sell_x,
       {EXCHANGE_NAME_SQL.format(c='buy_x')} AS buy_exchange,
       {EXCHANGE_NAME_SQL.format(c='sell_x')} AS sell_exchange,
       buy_price, sell_price, final_qty AS quantity, buy_price * final_qty AS value, prior_value
FROM executed WHERE final_qty > 0"""

ORACLE["stored_pairs"] = "WITH " + LISTINGS + """
SELECT pair FROM cross_pairs"""

ORACLE["pnl_status"] = THRESHOLD_CTES + """,
final AS (SELECT st.*, h.alert_ts FROM st LEFT JOIN hits h USING (command_id))
SELECT (SELECT cum_pnl FROM cum ORDER BY ts DESC, order_id DESC LIMIT 1) AS current_pnl,
       (SELECT CASE WHEN threshold > 0 AND alert_ts IS NULL THEN threshold END
          FROM final WHERE threshold >= 0 ORDER BY ts DESC, command_id DESC LIMIT 1) AS threshold,
       (SELECT bool_or(alert_ts IS NOT NULL) FROM final) AS threshold_reached,
       NOT (SELECT bool_or(alert_ts IS NOT NULL) FROM final) AS trading_active"""

ORACLE["transaction_status_updates"] = "WITH " + ORDERS + """,
tx AS (
  SELECT transaction_id, count(*) AS n, count(*) FILTER (WHERE status = 'FullyFilled') AS n_full,
         count(*) FILTER (WHERE status = 'NotFilled') AS n_none
  FROM orders_fx GROUP BY transaction_id
),
cur AS (
  SELECT transaction_id, CASE WHEN n_full = n THEN 'Fulfilled' WHEN n_none = n THEN 'Cancelled'
                              ELSE 'PartiallyFulfilled' END AS old_status
  FROM tx
),
upd AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
         CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Submitted'
              ELSE 'PartiallyFulfilled' END AS new_status
  FROM orders
)
SELECT u.transaction_id, u.new_status,
       CASE WHEN c.old_status IS NOT NULL AND c.old_status <> u.new_status THEN u.new_status ELSE c.old_status END
         AS status,
       CASE WHEN c.old_status IS NOT NULL AND c.old_status <> u.new_status
            THEN 'Transaction status updated successfully.'
            ELSE 'No transaction found with the given TransactionId.' END AS result
FROM upd u LEFT JOIN cur c USING (transaction_id)"""

# Executions under parameter updates and stops: evaluations at every seen tick of its pair and at each
# segment's first tick of every cached pair, reduced to the first of each key and segment, then one by one.
ORACLE["trading_updates"] = "WITH RECURSIVE " + LIVE_TEMPLATE.split("px AS (")[0].replace("{tick_where}", "") + f"""
updates AS (
  SELECT CAST(n_nationkey * (SELECT max(event_id) + 1 FROM events) // 25 + 37 AS BIGINT) AS effective_seq,
         CAST(2 + n_regionkey AS DOUBLE) AS min_spread, CAST(4 + 2 * n_regionkey AS DOUBLE) AS min_profit,
         CAST(900 AS DOUBLE) AS max_tx, CAST(1500 + 700 * n_nationkey AS DOUBLE) AS max_tv, n_nationkey % 9 <> 6 AS active
  FROM nation WHERE n_nationkey % 3 = 0
),
seen AS (
  SELECT t.*, u.effective_seq AS seg FROM ticks t ASOF LEFT JOIN updates u ON t.seq >= u.effective_seq
  WHERE u.effective_seq IS NULL OR u.active
),
firsts_of AS (SELECT seg, min(seq) AS seq FROM seen WHERE seg IS NOT NULL GROUP BY seg),
asked AS (
  SELECT seq, pair, seg FROM seen WHERE seg IS NOT NULL
  UNION SELECT f.seq, p.pair, f.seg FROM firsts_of f JOIN (SELECT DISTINCT pair FROM seen) p ON true
),
px AS (SELECT DISTINCT pair, x FROM seen),
latest AS (
  SELECT g.pair, g.seq, g.seg, g.x, q.bp, q.bs, q.ap, q."as"
  FROM (SELECT a.pair, a.seq, a.seg, px.x FROM asked a JOIN px ON a.pair = px.pair) g
  ASOF JOIN seen q ON g.pair = q.pair AND g.x = q.x AND g.seq >= q.seq
),
opps AS (
  SELECT b.pair, b.seq, b.seg, b.x AS buy_x, s.x AS sell_x, b.ap AS buy_price, s.bp AS sell_price,
         least(b."as", s.bs) AS quantity, (s.bp - b.ap) * least(b."as", s.bs) AS profit
  FROM latest b JOIN latest s ON b.pair = s.pair AND b.seq = s.seq AND b.x <> s.x
  JOIN updates u ON u.effective_seq = b.seg
  WHERE s.bp - b.ap >= u.min_spread AND (s.bp - b.ap) * least(b."as", s.bs) >= u.min_profit
    AND b.ap * least(b."as", s.bs) <= u.max_tx
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, seq
                     ORDER BY profit DESC, CAST(buy_x AS VARCHAR), CAST(sell_x AS VARCHAR)) AS rn FROM opps) WHERE rn = 1
),
cand AS (
  SELECT c.*, u.max_tv, CAST(buy_price * quantity AS DECIMAL(38,10)) AS value_dec,
         pair || ':' || buy_x || '>' || sell_x AS key, row_number() OVER (ORDER BY seq, pair) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY seg, pair, buy_x, sell_x ORDER BY seq) AS rk
        FROM best WHERE quantity > 0) c JOIN updates u ON u.effective_seq = c.seg WHERE rk = 1
),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seg, CAST(0 AS DECIMAL(38,10)) AS run,
         CAST(0 AS DECIMAL(38,10)) AS spent, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS DECIMAL(38,10)) AS prior,
         CAST(NULL AS DOUBLE) AS qty
  UNION ALL
  SELECT n, seg, CASE WHEN again THEN prior ELSE CAST(prior + value_dec AS DECIMAL(38,10)) END,
         CASE WHEN qty > 0 THEN CAST(spent + CAST(buy_price * qty AS DECIMAL(38,10)) AS DECIMAL(38,10)) ELSE spent END,
         CASE WHEN qty > 0 THEN list_append(done, key) ELSE done END, prior, qty
  FROM (
    SELECT *, CASE WHEN again THEN NULL WHEN prior + value_dec > CAST(max_tv AS DECIMAL(38,10))
                   THEN (max_tv - CAST(prior AS DOUBLE)) / buy_price ELSE quantity END AS qty
    FROM (SELECT c.n, c.seg, c.key, c.buy_price, c.quantity, c.value_dec, c.max_tv, w.spent, w.done,
                 list_contains(w.done, c.key) AS again,
                 CASE WHEN w.seg IS DISTINCT FROM c.seg THEN w.spent ELSE w.run END AS prior
          FROM walk w JOIN cand c ON c.n = w.n + 1))
)
SELECT c.pair, c.seq, c.buy_x, c.sell_x,
       {EXCHANGE_NAME_SQL.format(c='c.buy_x')} AS buy_exchange, {EXCHANGE_NAME_SQL.format(c='c.sell_x')} AS sell_exchange,
       c.buy_price, c.sell_price, w.qty AS quantity, c.buy_price * w.qty AS value, CAST(w.prior AS DOUBLE) AS prior_value
FROM walk w JOIN cand c ON c.n = w.n WHERE w.qty > 0"""

ORACLE["stream_trading_updates"] = ORACLE["trading_updates"]

ORACLE["stream_threshold_alerts"] = THRESHOLD_CTES + """
SELECT h.command_id, h.alert_ts, h.alert_order_id, h.alert_cum_pnl FROM hits h"""

ORACLE["transaction_status_log"] = ORACLE["transaction_status_updates"].split("upd AS (")[0] + """
upd AS (
  SELECT CASE WHEN l_linenumber = 7 THEN 'x' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS transaction_id,
         CAST(l_shipdate AS TIMESTAMP) AS updated_at, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS line,
         CASE (l_partkey + l_suppkey) % 3 WHEN 0 THEN 'Fulfilled' WHEN 1 THEN 'Submitted'
              ELSE 'PartiallyFulfilled' END AS new_status
  FROM lineitem
)
SELECT transaction_id, updated_at, line, new_status, CASE WHEN old_status IS NOT NULL THEN new_status END AS status,
       CASE WHEN old_status IS NOT NULL AND new_status <> before
            THEN 'Transaction status updated successfully.'
            ELSE 'No transaction found with the given TransactionId.' END AS result
FROM (SELECT u.*, c.old_status, lag(new_status, 1, c.old_status)
                    OVER (PARTITION BY u.transaction_id ORDER BY updated_at, line, new_status) AS before
      FROM upd u LEFT JOIN cur c USING (transaction_id))"""

ORACLE["order_lookup"] = "WITH " + ORDERS + """,
keys AS (
  SELECT DISTINCT CASE WHEN CAST(transaction_id AS BIGINT) % 13 = 0 THEN 'x' || order_id ELSE order_id END AS order_id
  FROM orders_fx WHERE CAST(transaction_id AS BIGINT) % 5 = 0
),
stored AS (
  SELECT order_id, status, filled_quantity, row_number() OVER (PARTITION BY order_id ORDER BY status, filled_quantity) AS n
  FROM orders_fx
)
SELECT k.order_id, s.status, s.filled_quantity, CASE WHEN s.order_id IS NULL THEN 'Order not found' END AS error
FROM keys k LEFT JOIN stored s ON s.order_id = k.order_id AND s.n = 1"""

ORACLE["maximal_trading_value"] = "WITH " + STRATEGIES + """
SELECT strategy_id, number_of_currencies, minimal_price_spread, min_transaction_profit, maximal_transaction_value,
       coalesce((SELECT max(maximal_trading_value) FROM checked WHERE error IS NULL), 0) AS maximal_trading_value, init_investment
FROM checked"""

ORACLE["stream_hist_opportunities"] = "WITH " + HIST.replace(
    "FROM quotes)", "FROM quotes WHERE t // 21600000 < (SELECT max(t // 21600000) FROM quotes))", 1) + """
SELECT pair, opportunities FROM hist_counts"""

ORACLE["quote_file"] = "WITH " + QUOTES + """
SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, pair, x, bp, ap, t FROM quotes"""
