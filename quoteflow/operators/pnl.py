"""Profit and loss (C6): weighted-average-cost inventory, realized P&L,
cumulative P&L with threshold alerts, annualized return.

Fold rules kept from the reference (per pair, in trade order):
* buy a@p: q' = q + a; cost' = (q*cost + a*p) / q' (0 when q' <= 0); the
  position exists afterwards even when q' = 0;
* sell a@p with a position and q >= a: realize (p - cost) * a; q' = q - a;
  the position is removed when q' = 0;
* sell with a position but q < a: ignored (no short selling);
* sell without a position: the whole revenue p * a is profit.
Quantities are whole numbers of 1e-8 (``UNITS`` to the unit), so every
accept, ignore and remove decision is exact; a net position is held up to
9.2e10, beyond which the fold raises. Only the average cost is double. Realized
amounts are cast to DECIMAL(38,6) per trade, so every later sum is exact and
independent of summation order.

The fold is a per-pair sequential recurrence (the ignore rule makes it
non-associative). It runs over blocks of a pair's trades in parallel, each a streaming
fold in ``mapInPandas`` in constant memory; ``fold_blocks`` gives the blocks of long
pairs their entry states, ``position`` says how rounding is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators.first_reach import first_reaching
from quoteflow.operators.fold_blocks import ORDER as FOLD_ORDER
from quoteflow.operators.fold_blocks import blocks_of
from quoteflow.operators.position import FAN, LEAF_ROWS, UNITS, Position
from quoteflow.operators.running import global_prefix_sum, next_in_order, ordered_blocks
from quoteflow.plans.joins import cache_small
from quoteflow.session import checkpoint_dir

PNL = T.DecimalType(38, 6)

# Messages of the reference's validations.
MSG_THRESHOLD_NEGATIVE = "Threshold must be non-negative"
MSG_INVEST_NOT_SET = "Initial investment amount not set"
MSG_NOT_STARTED = "Trading has not been started yet"
MSG_PNL_NEGATIVE = "PNL should be non-negative"
MSG_INVEST_NOT_POSITIVE = "Initial investment should be larger than 0"
MSG_DURATION_NOT_POSITIVE = "Duration of Year should be larger than 0"

TRADE_ORDER = ["ts", "order_id"]


# ----------------------------------------------------------------- F5 / F7
def orders_in_period(orders: DataFrame, start: str, end: str,
                     status: str | None = "FullyFilled") -> DataFrame:
    """start <= ts <= end (both inclusive) and the given status. The ts
    bounds are plain comparisons, so they reach the Parquet scan."""
    o = orders.where((F.col("ts") >= F.lit(start).cast(orders.schema["ts"].dataType))
                     & (F.col("ts") <= F.lit(end).cast(orders.schema["ts"].dataType)))
    return o.where(F.col("status") == status) if status else o


def completed_orders(orders: DataFrame) -> DataFrame:
    """Orders that reach the live P&L: fully or partially filled."""
    return orders.where(F.col("status").isin("FullyFilled", "PartiallyFulfilled"))


def order_to_trade(orders: DataFrame, strict: bool = True) -> DataFrame:
    """side from the lower-cased type; an unknown type raises (strict) or
    becomes null. Amount is the filled quantity, price the order price."""
    side = F.lower(F.col("type"))
    bad = ~side.isin("buy", "sell")
    side = F.when(bad, F.raise_error(F.lit("Unknown order type")) if strict else F.lit(None)).otherwise(side)
    return orders.select(
        F.col("currency_pair").alias("pair"), "order_id", side.alias("side"),
        F.col("filled_quantity").alias("amount"),
        F.col("order_price").cast("double").alias("price"),
        "ts")


# --------------------------------------------------------------- A7-A9 fold
FOLD_SCHEMA = T.StructType([
    T.StructField("pair", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("side", T.StringType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("avg_cost", T.DoubleType()),
    T.StructField("has_position", T.BooleanType()),
])


def in_units(trades: DataFrame) -> DataFrame:
    """The fold's input columns, ``amount`` as a whole number of 1e-8."""
    return trades.select(
        "pair", "order_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "side",
        (F.col("amount").cast("decimal(26,8)") * F.lit(UNITS)).cast("bigint").alias("amount"),
        F.col("price").cast("double").alias("price"))


def _fold_batches(leaf_rows: int, fan: int):
    """Streaming fold over rows sorted by (pair, block, order): one position at a
    time, carried across Arrow batches. Without a block column a pair is one block
    that begins without a position."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for b in batches:
            if not len(b):
                continue
            pair = b["pair"].values
            blk = b["blk"].values if "blk" in b else np.zeros(len(b), np.int64)
            cuts = np.flatnonzero((pair[1:] != pair[:-1]) | (blk[1:] != blk[:-1])) + 1
            sides, amounts, prices = b["side"].tolist(), b["amount"].tolist(), b["price"].tolist()
            cols = ([], [], [], [])
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if at != (pair[i], blk[i]):
                    at, now = (pair[i], blk[i]), Position(leaf=leaf_rows, fan=fan)
                    if "blk" in b:
                        has, q = np.frombuffer(b["position"].iloc[i], "<i8").tolist()
                        (c,) = np.frombuffer(b["state"].iloc[i], "<f8").tolist()
                        now = Position(q, bool(has), c, int(b["ord"].iloc[i]), leaf=leaf_rows, fan=fan)
                for acc, part in zip(cols, now.run(sides[i:j], amounts[i:j], prices[i:j])):
                    acc.extend(part)
            yield pd.DataFrame({
                "pair": b["pair"], "order_id": b["order_id"], "ts": b["ts"], "side": b["side"],
                "delta": cols[0], "quantity": cols[1], "avg_cost": cols[2], "has_position": cols[3]})

    return fold


#: Trades a task folds of one pair at most: a power of two of leaves, one node's at most.
BLOCK_ROWS = LEAF_ROWS * FAN


def fold_trades(trades: DataFrame, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """A9 per trade: realized P&L of the trade and the position after it.

    Every pair is folded in blocks of ``block_rows`` trades, in parallel. A pair's first
    block begins without a position; pairs with more blocks get the others' entry states by tree
    reductions over leaves (``fold_blocks``). Results do not depend on ``block_rows``, to the last bit.
    The pairs with more than one block are at most total / block_rows, a bound for the broadcast.
    """
    blocks = block_rows // leaf_rows
    if block_rows % leaf_rows or blocks & (blocks - 1) or not 0 < blocks <= fan or fan & (fan - 1):
        raise ValueError("block_rows must be leaf_rows times a power of two, at most fan")
    t = in_units(trades)
    long = t.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("pair")
    long = cache_small(long)
    fold = _fold_batches(leaf_rows, fan)
    short = t
    if long.limit(1).count():
        short = t.join(F.broadcast(long), "pair", "left_anti")
    out = (short.repartition("pair").sortWithinPartitions("pair", *FOLD_ORDER).mapInPandas(fold, FOLD_SCHEMA))
    if short is not t:
        cut = blocks_of(t.join(F.broadcast(long), "pair", "left_semi"), block_rows, leaf_rows, fan)
        out = out.unionByName(cut.mapInPandas(fold, FOLD_SCHEMA))
    return out.withColumn("pnl", F.col("delta").cast(PNL))


#: A position that later trades continue.
POSITION_SCHEMA = T.StructType([
    T.StructField("pair", T.StringType()), T.StructField("q", T.LongType()), T.StructField("has", T.BooleanType()),
    T.StructField("c", T.DoubleType()), T.StructField("n", T.LongType()),
    T.StructField("levels", T.ArrayType(T.DoubleType())),          # (entry cost, a, b) of the leaf and its nodes
])
_STATE = [f"state_{f.name}" for f in POSITION_SCHEMA.fields[1:]]


def _continued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold rows sorted by (pair, order) on from each pair's position; a row with the state columns holds the
    position after a pair's last trade. Holds one Arrow batch and one position."""
    at, now, states = None, None, []
    names = FOLD_SCHEMA.fieldNames()

    def done():
        if now is not None:
            states.append((at, *[None] * (len(names) - 1), now.q, now.has, now.c, now.n,
                           [float(x) for level in now.levels for x in level]))

    def left():
        return pd.DataFrame(states, columns=[*names, *_STATE], dtype=object)

    for b in batches:
        if not len(b):
            continue
        pair, known = b["pair"].values, b["n"].notna().values
        cuts = np.flatnonzero(pair[1:] != pair[:-1]) + 1
        sides, amounts, prices = b["side"].tolist(), b["amount"].tolist(), b["price"].tolist()
        cols = ([], [], [], [])
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            if now is None or pair[i] != at:
                done()
                at, now = pair[i], Position()
                if known[i]:
                    r = b.iloc[i]
                    flat = [float(x) for x in r["levels"]]
                    now = Position(int(r["q"]), bool(r["has"]), float(r["c"]), int(r["n"]),
                                   [tuple(flat[k:k + 3]) for k in range(0, len(flat), 3)])
            for acc, part in zip(cols, now.run(sides[i:j], amounts[i:j], prices[i:j])):
                acc.extend(part)
        yield b[names[:4]].assign(delta=cols[0], quantity=cols[1], avg_cost=cols[2], has_position=cols[3],
                                  **dict.fromkeys(_STATE))
        if states:
            yield left()
            states.clear()
    done()
    if states:
        yield left()


def fold_onwards(trades: DataFrame, positions: DataFrame) -> DataFrame:
    """A9 from stored positions (``POSITION_SCHEMA``, one row a pair): the per-trade rows, and one
    row with the state columns for each pair of ``trades``, its position afterwards (``positions_after``). Same bits as
    one fold over all trades."""
    schema = T.StructType(FOLD_SCHEMA.fields + [
        T.StructField(n, f.dataType) for n, f in zip(_STATE, POSITION_SCHEMA.fields[1:])])
    t = in_units(trades).join(positions, "pair", "left").repartition("pair").sortWithinPartitions("pair", *FOLD_ORDER)
    return t.mapInPandas(_continued, schema)


def positions_after(onwards: DataFrame) -> DataFrame:
    return onwards.where("state_n IS NOT NULL").select(
        "pair", *[F.col(n).alias(f.name) for n, f in zip(_STATE, POSITION_SCHEMA.fields[1:])])


def pnl_by_pair(folded: DataFrame) -> DataFrame:
    """Realized P&L per pair and the final position (the last trade's state)."""
    last = F.max(F.struct(*TRADE_ORDER, "quantity", "avg_cost", "has_position"))
    g = folded.groupBy("pair").agg(
        F.sum("pnl").alias("realized_pnl"), F.count(F.lit(1)).alias("n_trades"), last.alias("last"))
    return g.select("pair", "realized_pnl", "n_trades",
                    F.col("last.quantity").alias("quantity"),
                    F.col("last.avg_cost").alias("avg_cost"),
                    F.col("last.has_position").alias("has_position"))


def inventory(folded: DataFrame) -> DataFrame:
    """Open positions after the last trade (a zero-quantity position after a
    zero buy is still a position)."""
    return pnl_by_pair(folded).where("has_position").select("pair", "quantity", "avg_cost")


def total_pnl(folded: DataFrame) -> DataFrame:
    """A10: total realized P&L (one row)."""
    return folded.agg(F.coalesce(F.sum("pnl"), F.lit(0).cast(PNL)).alias("total_pnl"),
                      F.count(F.lit(1)).alias("n_trades"))


# ------------------------------------------------------------------ W5 / W6
#: Column of the range blocks that ``cumulative_blocks`` keeps.
BLOCK = "_gblk"


def cumulative_blocks(folded: DataFrame) -> DataFrame:
    """W5 with its range blocks, written to the shared checkpoint folder: what several
    readers of the running P&L start from."""
    checkpoint_dir(folded.sparkSession)
    return global_prefix_sum(folded.select("ts", "order_id", "pair", "pnl"), "pnl",
                             TRADE_ORDER, "cum_pnl", inclusive=True, keep=BLOCK).checkpoint(eager=True)


def cumulative_pnl(folded: DataFrame) -> DataFrame:
    """Portfolio P&L after every trade, over the global trade order,
    as a range-blocked running sum (no one-task window)."""
    return global_prefix_sum(folded.select("ts", "order_id", "pair", "pnl"), "pnl",
                             TRADE_ORDER, "cum_pnl", inclusive=True)


def threshold_status(commands: DataFrame) -> DataFrame:
    """negative -> error, 0 -> clears, positive -> sets."""
    return commands.withColumn(
        "status", F.when(F.col("threshold") < 0, F.lit("error: " + MSG_THRESHOLD_NEGATIVE))
        .when(F.col("threshold") == 0, F.lit("cleared")).otherwise(F.lit("set")))


def threshold_alerts(cum: DataFrame, commands: DataFrame) -> DataFrame:
    """For each threshold that takes effect, the first trade at or after
    it (and before the next valid command) whose cumulative P&L reaches it.

    Commands at one timestamp apply before that timestamp's trades; an error
    command changes nothing; of several valid commands at one timestamp the
    last (by id) is the effective one. The search is a two-level index over range
    blocks of trades (``first_reach``). ``cum`` may bring its blocks
    (``cumulative_blocks``, written); else the rows are cut and written here.
    """
    cmds = threshold_status(commands)
    valid = cmds.where(F.col("threshold") >= 0)
    eff = valid.groupBy("ts").agg(F.max(F.struct("command_id", "threshold")).alias("e"))
    eff = eff.select("ts", F.col("e.command_id").alias("command_id"), F.col("e.threshold").alias("threshold"))
    eff = next_in_order(eff, "ts", "next_ts")
    active = eff.where(F.col("threshold") > 0).select("command_id", F.col("ts").alias("cmd_ts"), "next_ts", "threshold")
    checkpoint_dir(cum.sparkSession)
    if BLOCK in cum.columns:
        rows = cum.select("ts", "order_id", "cum_pnl", F.col(BLOCK).alias("blk"))
    else:
        rows = ordered_blocks(cum.select("ts", "order_id", "cum_pnl"), TRADE_ORDER, block_col="blk")
    first = first_reaching(rows, active.checkpoint())
    return cmds.join(first, "command_id", "left").select(
        "command_id", "ts", "threshold", "status", "alert_ts", "alert_order_id", "alert_cum_pnl")


# ------------------------------------------------------------- A11 / F10
def annualized_return(portfolios: DataFrame) -> DataFrame:
    """A11 + F10: years = days / 365.0; checks in the reference's order (investment set, trading started,
    then P&L, investment, duration), first error wins; the return is
    (pnl / invest) ** (1 / years) - 1 (base pnl/invest, as the reference). Without a P&L it is 0; a
    null end date is no duration."""
    years = F.datediff("end_date", "start_date").cast("double") / F.lit(365.0)
    p = portfolios.withColumn("years", years).withColumn("cum_pnl", F.coalesce("cum_pnl", F.lit(0.0)))
    err = (F.when(F.col("init_invest").isNull(), F.lit(MSG_INVEST_NOT_SET))
           .when(F.col("start_date").isNull(), F.lit(MSG_NOT_STARTED))
           .when(F.col("cum_pnl") < 0, F.lit(MSG_PNL_NEGATIVE))
           .when(F.col("init_invest") <= 0, F.lit(MSG_INVEST_NOT_POSITIVE))
           .when(~F.coalesce(F.col("years") > 0, F.lit(False)), F.lit(MSG_DURATION_NOT_POSITIVE)))
    ret = F.pow(F.col("cum_pnl") / F.col("init_invest"), F.lit(1.0) / F.col("years")) - F.lit(1.0)
    return p.select("portfolio_id", "init_invest", "cum_pnl", "years", err.alias("error"),
                    F.when(err.isNull(), ret).alias("annualized_return"))


def pnl_status(cum: DataFrame, alerts: DataFrame) -> DataFrame:
    """The P&L agent's status after all trades and commands (one row):
    current P&L, the threshold still in force (cleared by 0 or by being
    reached), whether any threshold was ever reached, and the trading gate
    (never re-opened once a threshold is reached). Without trades the P&L is 0;
    without commands no threshold is reached and trading is active.

    One aggregate over a union of both inputs, so the single-row answer is
    built by partial/final aggregation without a join."""
    last = F.struct("ts", "order_id", "cum_pnl")
    alerted = F.col("alert_ts").isNotNull()
    u = cum.select(last.alias("last"), F.lit(None).cast("struct<ts:timestamp_ntz,command_id:bigint,"
                                                          "threshold:decimal(18,2),alerted:boolean>").alias("cmd"),
                   F.lit(None).cast("boolean").alias("alerted"))
    cmd = F.when(F.col("threshold") >= 0, F.struct(
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("command_id").cast("bigint").alias("command_id"),
        F.col("threshold").cast("decimal(18,2)").alias("threshold"), alerted.alias("alerted")))
    u = u.unionByName(alerts.select(F.lit(None).cast(u.schema["last"].dataType).alias("last"),
                                    cmd.alias("cmd"), alerted.alias("alerted")))
    r = u.agg(F.max("last").alias("last"), F.max("cmd").alias("cmd"), F.max("alerted").alias("reached"))
    threshold = F.when((F.col("cmd.threshold") > 0) & ~F.col("cmd.alerted"), F.col("cmd.threshold"))
    reached = F.coalesce("reached", F.lit(False))
    return r.select(F.coalesce("last.cum_pnl", F.lit(0).cast(PNL)).alias("current_pnl"), threshold.alias("threshold"),
                    reached.alias("threshold_reached"), (~reached).alias("trading_active"))
