"""Order ledger (C5): order legs of executed opportunities, fill
reconciliation, remainder chains and the latest order state.

The reference submits and polls orders one by one over HTTP; here the
payloads are landed tables and every step is a set operation:
* legs: one ``explode`` of a two-element array per execution;
* fills: equi-join of orders to status reports on (exchange, order_id),
  left outer so missing reports stay visible, parsed per venue;
* remainder chain: attempts of one order form a bounded group (a window
  per order);
* latest state: an append-only event log reduced with ``max(struct(version,
  ...))`` per order id (partial + final aggregate); an update without a
  stored order is found in the same aggregate instead of a per-row lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions import orders as OF
from quoteflow.functions.pairs import opportunity_key
from quoteflow.plans.joins import join_small

# Results of an order-state update.
MSG_UPDATED = "Success"
MSG_NOT_UPDATED = "No order updated"


# Why a leg is not submitted.
MSG_STOPPED = "Trading is stopped due to P&L threshold reached."
MSG_NOT_SUPPORTED = "Exchange not supported"


def gated(executed: DataFrame, ticks: DataFrame, closed_ms) -> DataFrame:
    """``executed`` with ``orders_submitted``: whether its tick came before the P&L gate closed (``closed_ms``, epoch ms;
    null: open). Executions are at most one per opportunity key, so they are broadcast behind a size check."""
    at = join_small(ticks.select("seq", "t"), executed, "seq")
    return at.withColumn("orders_submitted", F.coalesce(F.col("t") < F.lit(closed_ms), F.lit(True))).drop("t")


def order_legs(executed: DataFrame) -> DataFrame:
    """X12 + X6 + X7: two Pending legs per execution sharing a transaction id.

    The id is a SHA-256 of the opportunity key and tick, so a retried job
    produces the same ids (a random UUID would not). ``error`` says why a leg is not submitted: the gate is closed
    (``orders_submitted`` false, if there is that column), or the venue is not supported; such a leg has no symbol."""
    key = opportunity_key(F.col("pair"), F.col("buy_x"), F.col("sell_x"))
    tx = F.sha2(F.concat(key, F.lit("@"), F.col("seq").cast("string")), 256)
    legs = F.array(
        F.struct(F.lit("buy").alias("type"), F.col("buy_exchange").alias("exchange"),
                 F.col("buy_price").alias("order_price")),
        F.struct(F.lit("sell").alias("type"), F.col("sell_exchange").alias("exchange"),
                 F.col("sell_price").alias("order_price")))
    go = F.col("orders_submitted") if "orders_submitted" in executed.columns else F.lit(True)
    e = executed.select(tx.alias("transaction_id"), "pair", "seq", "quantity", go.alias("go"), F.explode(legs).alias("leg"))
    symbol = OF.venue_symbol(F.col("leg.exchange"), F.col("pair"))
    error = F.when(~F.col("go"), F.lit(MSG_STOPPED)).when(symbol.isNull(), F.lit(MSG_NOT_SUPPORTED))
    return e.select(
        "transaction_id", "pair", "seq", "leg.type", "leg.exchange", "leg.order_price",
        F.col("quantity").alias("order_quantity"),
        F.lit(OF.PENDING).alias("status"),
        symbol.alias("symbol"),
        OF.signed_amount(F.col("leg.exchange"), F.col("leg.type"), F.col("quantity")).alias("signed_amount"),
        error.alias("error"))


def fill_amounts(orders: DataFrame, reports: DataFrame) -> DataFrame:
    """J6 + X9: each order's filled quantity from its venue's status report."""
    o = orders.select("order_id", "exchange", "order_quantity")
    # Both sides grow with the data (one report per order): never a
    # broadcast, whatever a small file's size estimate says.
    r = reports.select("exchange", "order_id", "payload").hint("merge")
    j = o.join(r, ["exchange", "order_id"], "left")
    filled = OF.filled_quantity(F.col("exchange"), F.col("payload"), F.col("order_id"), F.col("order_quantity"))
    return j.select("order_id", "exchange", "order_quantity", filled.alias("filled"),
                    F.col("payload").isNotNull().alias("has_report"))


def fill_status(fills: DataFrame) -> DataFrame:
    """Classification of each reported fill; NotFilled rows are the
    reference's notification cases. Unreadable reports update no order
    (``readable``)."""
    return fills.where("has_report").select(
        "order_id", "exchange", "order_quantity", "filled",
        OF.fill_status(F.col("filled"), F.col("order_quantity")).alias("status"))


def readable(statuses: DataFrame) -> DataFrame:
    """The classified fills that may update an order (G1)."""
    return statuses.where(F.col("status") != OF.UNREADABLE)


def order_chain(attempts: DataFrame) -> DataFrame:
    """Remainder chain. Attempt k asks for the original quantity minus
    earlier fills; the chain continues while attempts are partial and stops
    at the first full or empty fill. ``attempts``: (transaction_id, type,
    attempt, order_id, order_quantity, filled_quantity), ordered by (attempt,
    order_id); the first attempt's quantity
    is the order's, later quantities follow from the fills."""
    w = Window.partitionBy("transaction_id", "type").orderBy("attempt", "order_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    a = attempts.withColumn("initial", F.first("order_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("prior_fill", F.coalesce(F.sum("filled_quantity").over(before), F.lit(0)))
    a = a.withColumn("requested", (F.col("initial") - F.col("prior_fill")).cast(OF.QTY))
    a = a.withColumn("status", OF.fill_status(F.col("filled_quantity"), F.col("requested")))
    a = a.withColumn("stops_before", F.coalesce(
        F.sum(F.when(F.col("status") != OF.PARTIALLY, 1).otherwise(0)).over(before), F.lit(0)))
    kept = a.where(F.col("stops_before") == 0)
    last = F.max(F.struct("attempt", "order_id", "status", "requested", "filled_quantity"))
    g = kept.groupBy("transaction_id", "type").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("filled_quantity").alias("total_filled"),
        F.max("initial").alias("initial_quantity"), last.alias("last"))
    return g.select("transaction_id", "type", "attempts", "initial_quantity",
                    F.col("total_filled").cast(OF.QTY).alias("total_filled"),
                    F.col("last.status").alias("final_status"),
                    (F.col("last.requested") - F.col("last.filled_quantity")).cast(OF.QTY).alias("remaining"))


def latest_orders(created: DataFrame, updates: DataFrame) -> DataFrame:
    """G1: apply (filled, status) updates to stored orders.

    ``created``: (order_id, status, filled_quantity), version 0.
    ``updates``: (order_id, version, status, filled_quantity).
    Matched orders get their latest version; an update for an unknown order
    is reported with the reference's error text. The match test is the
    minimum version per id (0 = stored), so no join is needed.
    """
    ev = created.select("order_id", F.lit(0).cast("bigint").alias("version"), "status", "filled_quantity") \
        .unionByName(updates.select("order_id", F.col("version").cast("bigint"), "status", "filled_quantity"))
    latest = ev.groupBy("order_id").agg(
        F.max(F.struct("version", "status", "filled_quantity")).alias("s"),
        F.min("version").alias("first_version"))
    return with_outcome(latest.select("order_id", "s.*", "first_version"))


def with_outcome(state: DataFrame) -> DataFrame:
    """G1: the result of each order's updates, from its latest row and least version (0: the order is stored)."""
    return state.select(
        "order_id", "version", "status", "filled_quantity",
        F.when(F.col("first_version") > 0, F.lit(MSG_NOT_UPDATED)).when(F.col("version") > 0, F.lit(MSG_UPDATED)).alias("result"))
