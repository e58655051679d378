"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Parameters are fixed here once per query (the adapted ``events`` span 30
days, so the historical bucket is 6 hours instead of the live feed's 5 ms).
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.functions import dates
from quoteflow.functions import orders as OF
from quoteflow.operators import history, ledger, listings, opportunities, orders, pnl, selection, strategy
from quoteflow.operators.change_log import ChangeLog
from quoteflow.session import scratch_path
from quoteflow.sources import adapters, quotes_json
from quoteflow.streaming import live

# Parameters of the registered queries.
HIST_BUCKET_MS = 21_600_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- C1 history
@register("hist_best_quotes")
def q_hist_best_quotes(spark, sf_dir):
    return history.best_quotes(adapters.quotes(spark, sf_dir), HIST_BUCKET_MS).select(
        "bucket", "pair", "x", "n_quotes", "bp", "ap", "best_seq")


@register("hist_opportunities")
def q_hist_opportunities(spark, sf_dir):
    return history.opportunities_per_pair(adapters.quotes(spark, sf_dir), HIST_BUCKET_MS)


@register("hist_report")
def q_hist_report(spark, sf_dir):
    counts = history.opportunities_per_pair(adapters.quotes(spark, sf_dir), HIST_BUCKET_MS)
    return history.report(counts)


# ---------------------------------------------------------- C2 cross-traded
PAIRS_TO_TRACK = 5


@register("listing_pairs")
def q_listing_pairs(spark, sf_dir):
    return listings.all_listings(adapters.listing_payloads(spark, sf_dir))


@register("cross_traded_pairs")
def q_cross_traded_pairs(spark, sf_dir):
    return listings.identify_cross_traded(adapters.listing_payloads(spark, sf_dir))


# ----------------------------------------------------------- C3 selection
@register("pairs_to_track")
def q_pairs_to_track(spark, sf_dir):
    counts = history.opportunities_per_pair(adapters.quotes(spark, sf_dir), HIST_BUCKET_MS)
    cross = listings.identify_cross_traded(adapters.listing_payloads(spark, sf_dir))
    out = selection.pairs_to_track(counts, cross, PAIRS_TO_TRACK)
    return out.withColumn("rank", out["rank"].cast("bigint"))


# ------------------------------------------------------ C4 live detection
LIVE_PARAMS = opportunities.TradingParams(
    min_spread=5.0, min_profit=10.0, max_transaction_value=900.0, max_trading_value=4000.0)


def _grid(spark, sf_dir):
    return opportunities.latest_quote_grid(adapters.live_quotes(spark, sf_dir))


@register("latest_quote_grid")
def q_latest_quote_grid(spark, sf_dir):
    return _grid(spark, sf_dir).drop("block")


@register("opportunities")
def q_opportunities(spark, sf_dir):
    return opportunities.opportunities(_grid(spark, sf_dir), LIVE_PARAMS).drop("block")


@register("best_opportunity")
def q_best_opportunity(spark, sf_dir):
    return opportunities.best_opportunity(_grid(spark, sf_dir), LIVE_PARAMS).drop("block")


@register("executed_opportunities")
def q_executed_opportunities(spark, sf_dir):
    best = opportunities.best_opportunity(_grid(spark, sf_dir), LIVE_PARAMS)
    return opportunities.executed_opportunities(best, LIVE_PARAMS)


# ------------------------------------------------------------------ C6 P&L
HIST_PNL_START = "1996-01-01 00:00:00"
HIST_PNL_END = "1999-12-31 00:00:00"


def _live_fold(spark, sf_dir):
    return pnl.fold_trades(pnl.order_to_trade(pnl.completed_orders(adapters.orders(spark, sf_dir))))


@register("pnl_by_pair")
def q_pnl_by_pair(spark, sf_dir):
    return pnl.pnl_by_pair(_live_fold(spark, sf_dir))


@register("inventory")
def q_inventory(spark, sf_dir):
    return pnl.inventory(_live_fold(spark, sf_dir))


@register("historical_pnl")
def q_historical_pnl(spark, sf_dir):
    o = pnl.orders_in_period(adapters.orders(spark, sf_dir), HIST_PNL_START, HIST_PNL_END)
    return pnl.total_pnl(pnl.fold_trades(pnl.order_to_trade(o)))


@register("cumulative_pnl")
def q_cumulative_pnl(spark, sf_dir):
    return pnl.cumulative_pnl(_live_fold(spark, sf_dir))


@register("threshold_alert")
def q_threshold_alert(spark, sf_dir):
    cum = pnl.cumulative_blocks(_live_fold(spark, sf_dir))
    return pnl.threshold_alerts(cum, adapters.threshold_commands(spark, sf_dir))


@register("annualized_return")
def q_annualized_return(spark, sf_dir):
    out = pnl.annualized_return(adapters.portfolios(spark, sf_dir))
    return out.withColumn("annualized_return", F.round("annualized_return", 10))   # engines' pow differ in the last bit


# ------------------------------------------------------------ C5 orders
@register("order_legs")
def q_order_legs(spark, sf_dir):
    best = opportunities.best_opportunity(_grid(spark, sf_dir), LIVE_PARAMS)
    return orders.order_legs(opportunities.executed_opportunities(best, LIVE_PARAMS))


@register("gated_order_legs")
def q_gated_order_legs(spark, sf_dir):
    """Legs of executions on venues known and not, before and after the P&L gate closes."""
    ticks = adapters.unlisted_quotes(spark, sf_dir)
    best = opportunities.best_opportunity(opportunities.latest_quote_grid(ticks), LIVE_PARAMS)
    executed = opportunities.executed_opportunities(best, LIVE_PARAMS)
    return orders.order_legs(orders.gated(executed, ticks, adapters.gate_closing(spark, sf_dir)))


def _fills(spark, sf_dir):
    return orders.fill_amounts(adapters.orders(spark, sf_dir), adapters.fill_reports(spark, sf_dir))


@register("fill_amounts")
def q_fill_amounts(spark, sf_dir):
    return _fills(spark, sf_dir)


@register("fill_status")
def q_fill_status(spark, sf_dir):
    return orders.fill_status(_fills(spark, sf_dir))


@register("order_chain")
def q_order_chain(spark, sf_dir):
    o = adapters.orders(spark, sf_dir)
    return orders.order_chain(o.select("transaction_id", "type", "attempt", "order_id", "order_quantity", "filled_quantity"))


def _created_and_updates(spark, sf_dir):
    """Orders as stored, and the updates of their readable reports; some reports name orders that are not stored."""
    created = adapters.orders(spark, sf_dir).select(
        "order_id", F.lit("Pending").alias("status"), F.lit(0).cast("decimal(18,8)").alias("filled_quantity"))
    upd = orders.readable(orders.fill_status(_fills(spark, sf_dir))).select(
        adapters.reported_id("order_id").alias("order_id"), F.lit(1).alias("version"), "status",
        F.col("filled").alias("filled_quantity"))
    return created, upd


@register("latest_orders")
def q_latest_orders(spark, sf_dir):
    return orders.latest_orders(*_created_and_updates(spark, sf_dir))


@register("order_log")
def q_order_log(spark, sf_dir):
    """S7 / G1 as a stored change log: orders, then their updates in two batches, one of them sent twice, with a
    compaction in between."""
    created, upd = _created_and_updates(spark, sf_dir)
    log = ChangeLog(spark, scratch_path(spark, _stream_name(spark, "orders")),
                    "order_id string, version long, status string, filled_quantity decimal(18,8)", "order_id")
    log.append(created.withColumn("version", F.lit(0).cast("long")), 0)
    halves = [upd.where(F.pmod(F.crc32(F.col("order_id").cast("binary")), F.lit(2)) == i) for i in (0, 1)]
    log.append(halves[0], 1)
    log.compact()
    log.append(halves[0], 1)
    log.append(halves[1], 2)
    return orders.with_outcome(log.state())


@register("submitted_orders")
def q_submitted_orders(spark, sf_dir):
    """The venues' order ids from their replies to submitted orders."""
    r = adapters.submit_replies(spark, sf_dir)
    return r.select("order_id", OF.submitted_order_id(F.col("exchange"), F.col("payload")).alias("venue_order_id"))


@register("period_requests")
def q_period_requests(spark, sf_dir):
    """Periods asked for as text."""
    return dates.period_requests(adapters.period_texts(spark, sf_dir)).select("request_id", "start_ts", "end_ts", "error")


@register("maximal_trading_value")
def q_maximal_trading_value(spark, sf_dir):
    """One maximal trading value, the largest valid one, set on every stored strategy."""
    s = strategy.validate(adapters.strategies(spark, sf_dir))
    top = s.where("valid").agg(F.max("maximal_trading_value")).first()[0]
    return strategy.set_maximal_trading_value(s.drop("error", "valid"), top or 0.0)


# --------------------------------------------------- F9 / ledger operators
@register("strategy_validation")
def q_strategy_validation(spark, sf_dir):
    return strategy.validate(adapters.strategies(spark, sf_dir)).select("strategy_id", "error", "valid")


@register("current_strategy")
def q_current_strategy(spark, sf_dir):
    return strategy.current_strategy(strategy.validate(adapters.strategies(spark, sf_dir)))


@register("transaction_history")
def q_transaction_history(spark, sf_dir):
    return ledger.transaction_history(ledger.transaction_events(adapters.orders(spark, sf_dir)))


# ------------------------------------------------ ST1-ST4 streaming forms
# Each runs a Structured Streaming query to completion (availableNow) over the
# driver table and returns its sink; results must equal the batch queries.
def _stream_name(spark, tag):
    """A fresh sink/checkpoint name under the shared checkpoint folder."""
    return f"{tag}-{time.time_ns()}"


#: Micro-batches that a query lands for a stream: so many at least, of about so many rows, in files of about so many.
LANDED_BATCHES, LANDED_ROWS, FILE_ROWS = 3, 4_000_000, 250_000


def _landed(spark, rows, order, path):
    """``rows`` landed in ``order``, as a stream. A micro-batch takes several files, so that several tasks read it."""
    n = rows.count()
    batches = max(LANDED_BATCHES, -(-n // LANDED_ROWS))
    files = max(1, -(-n // (batches * FILE_ROWS)))
    live.land_in_order(rows, order, path, batches * files)
    return live.landed_stream(spark, path, rows.schema, files)


@register("stream_latest_quote_grid")
def q_stream_latest_quote_grid(spark, sf_dir):
    ticks = adapters.live_quotes_frame(live.stream_table(spark, sf_dir, "events"))
    q, out = live.start_quote_grid(spark, ticks, _stream_name(spark, "grid"))
    q.awaitTermination()
    return live.read_written(spark, out, live.GRID_SCHEMA)


@register("stream_executed_opportunities")
def q_stream_executed_opportunities(spark, sf_dir):
    params = scratch_path(spark, _stream_name(spark, "params"))
    live.write_params(spark, params, 0, LIVE_PARAMS)
    ticks = adapters.live_quotes_frame(live.stream_table(spark, sf_dir, "events"))
    q, executed = live.start_live_trading(spark, ticks, params, name=_stream_name(spark, "live"))
    q.awaitTermination()
    cols = [c for c in live.EXECUTED_SCHEMA.fieldNames() if c not in ("batch_id", "value_dec", "orders_submitted")]
    return live.read_written(spark, executed, live.EXECUTED_SCHEMA).select(*cols)


@register("trading_updates")
def q_trading_updates(spark, sf_dir):
    """ST3 / ST6: executions under parameter updates and stops at their ticks."""
    return opportunities.executed_with_updates(adapters.live_quotes(spark, sf_dir), adapters.parameter_updates(spark, sf_dir))


@register("stream_trading_updates")
def q_stream_trading_updates(spark, sf_dir):
    """The same as a stream: ticks landed as files in arrival order, while updates and stops fall anywhere within the
    micro-batches."""
    name = _stream_name(spark, "updates")
    landed, params = scratch_path(spark, name + "-ticks"), scratch_path(spark, name + "-params")
    adapters.parameter_updates(spark, sf_dir).write.parquet(params)
    events = adapters.read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    ticks = adapters.live_quotes_frame(_landed(spark, events, "event_id", landed))
    q, executed = live.start_live_trading(spark, ticks, params, name=name)
    q.awaitTermination()
    cols = [c for c in live.EXECUTED_SCHEMA.fieldNames() if c not in ("batch_id", "value_dec", "orders_submitted")]
    return live.read_written(spark, executed, live.EXECUTED_SCHEMA).select(*cols)


@register("stream_hist_opportunities")
def q_stream_hist_opportunities(spark, sf_dir):
    """ST5: the historical scan as a stream over quotes that land in time order; the last bucket stays open."""
    name = _stream_name(spark, "buckets")
    landed, flags = scratch_path(spark, name + "-quotes"), scratch_path(spark, name + "-flags")
    events = adapters.read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    quotes = adapters.quotes_frame(_landed(spark, events, [adapters.epoch_ms(events, "ts")], landed))
    reps = live.stream_bucket_representatives(quotes, HIST_BUCKET_MS, "0 seconds")
    q = live.start_sink(spark, reps, live.BucketFlagSink(flags), name)
    q.awaitTermination()
    return live.bucket_report(spark, flags)


@register("stream_pnl_by_pair")
def q_stream_pnl_by_pair(spark, sf_dir):
    li = live.stream_table(spark, sf_dir, "lineitem")
    trades = pnl.order_to_trade(pnl.completed_orders(adapters.orders_frame(li)))
    q, out = live.start_pnl(spark, trades, _stream_name(spark, "pnl"))
    q.awaitTermination()
    return pnl.pnl_by_pair(live.read_folded(spark, out))


@register("stream_threshold_alerts")
def q_stream_threshold_alerts(spark, sf_dir):
    """ST4: folded trades -> running portfolio P&L -> alerts, landed in the order of trades."""
    name = _stream_name(spark, "alerts")
    landed = scratch_path(spark, name + "-lines")
    lines = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    stream = _landed(spark, lines, ["l_shipdate", F.expr(adapters.ORDER_ID)], landed)      # pnl.TRADE_ORDER
    trades = pnl.order_to_trade(pnl.completed_orders(adapters.orders_frame(stream)))
    sink = live.PortfolioSink(scratch_path(spark, name + "-cum"), scratch_path(spark, name + "-hits"),
                              adapters.threshold_commands(spark, sf_dir))
    q, _ = live.start_pnl(spark, trades, name, then=sink)
    q.awaitTermination()
    return live.read_written(spark, sink.alerts_path, live.ALERT_SCHEMA).drop("batch_id")


# ------------------------------------------------------------ S1-S3 frames
#: Quotes of a landed array file, which one task sorts.
ARRAY_ROWS = 1_000_000


@register("quote_file")
def q_quote_file(spark, sf_dir):
    """Quotes landed as JSON array files, read by byte ranges."""
    path = scratch_path(spark, _stream_name(spark, "arrays"))
    quotes_json.land_arrays(adapters.quotes(spark, sf_dir), path, ARRAY_ROWS)
    return quotes_json.read_quote_array(spark, path + "/*").select("seq", "pair", "x", "bp", "ap", "t")


@register("quote_frames")
def q_quote_frames(spark, sf_dir):
    """Live ticks landed as JSON frames of 16 quotes plus one status frame per
    64 ticks, then decoded by the frame reader (S2/S3)."""
    ticks = adapters.live_quotes(spark, sf_dir)
    frames = quotes_json.frames_from_ticks(ticks, 16)
    status = ticks.where(F.col("seq") % 64 == 0).select(
        (-F.col("seq") - 1).alias("frame_seq"),
        F.lit('[{"ev":"status","status":"auth_success","message":"authenticated"}]').alias("value"))
    out = quotes_json.live_frames(frames.unionByName(status))
    return out.select("seq", "ev", "pair", "bp", "bs", "ap", "as", "t", "x")


# ------------------------------------------------- E1 + E2 end to end
def _stored_pairs(spark, sf_dir):
    """C2 stored (S5) and read back."""
    path = scratch_path(spark, _stream_name(spark, "pairs"))
    listings.store_cross_traded(listings.identify_cross_traded(adapters.listing_payloads(spark, sf_dir)), path)
    return listings.stored_pairs(spark, path)


@register("stored_pairs")
def q_stored_pairs(spark, sf_dir):
    return _stored_pairs(spark, sf_dir)


@register("tracked_executions")
def q_tracked_executions(spark, sf_dir):
    """Start-trading flow: the current strategy's thresholds and number of pairs; historical scan, first N pairs
    that are in the stored cross-traded table; live detection and execution over those pairs' ticks
    only (the reference subscribes to just these pairs). Without a valid strategy nothing is traded."""
    current = strategy.trading_params(strategy.current_strategy(strategy.validate(adapters.strategies(spark, sf_dir))))
    if current is None:
        return spark.createDataFrame([], opportunities.EXECUTED_COLUMNS)
    params, n = current
    counts = history.opportunities_per_pair(adapters.quotes(spark, sf_dir), HIST_BUCKET_MS)
    tracked = selection.pairs_to_track(counts, _stored_pairs(spark, sf_dir), n).select("pair")          # at most N rows
    ticks = adapters.live_quotes(spark, sf_dir).join(F.broadcast(tracked), "pair", "left_semi")
    best = opportunities.best_opportunity(opportunities.latest_quote_grid(ticks), params)
    return opportunities.executed_opportunities(best, params)


@register("pnl_status")
def q_pnl_status(spark, sf_dir):
    cum = pnl.cumulative_blocks(_live_fold(spark, sf_dir))
    alerts = pnl.threshold_alerts(cum, adapters.threshold_commands(spark, sf_dir))
    return pnl.pnl_status(cum, alerts)


@register("transaction_status_log")
def q_transaction_status_log(spark, sf_dir):
    """G2 with repeated updates of one transaction, in order, and of transactions that are not stored."""
    state = ledger.latest_transactions(ledger.transaction_events(adapters.orders(spark, sf_dir)))
    return ledger.update_transaction_status(state, adapters.transaction_status_log(spark, sf_dir), ("updated_at", "line"))


@register("order_lookup")
def q_order_lookup(spark, sf_dir):
    """The orders of venue reports looked up by id, every 13th of them under an id that is not stored."""
    o = adapters.orders(spark, sf_dir).select("order_id", "status", "filled_quantity")
    return ledger.find(o, adapters.lookup_keys(spark, sf_dir), "order_id")


@register("transaction_status_updates")
def q_transaction_status_updates(spark, sf_dir):
    """The transaction ledger (from the order lines) receives one status
    update per ``orders`` row, status from o_orderstatus."""
    state = ledger.latest_transactions(ledger.transaction_events(adapters.orders(spark, sf_dir)))
    upd = adapters.transaction_status_updates(spark, sf_dir)
    return ledger.update_transaction_status(state, upd)
