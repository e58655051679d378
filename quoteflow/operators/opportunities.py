"""Real-time arbitrage detection (C4), replayed in batch over arrival order.

Reference behaviour restated:
* a cache keeps the latest quote per (pair, exchange), last arrival wins;
* after every tick the ticked pair's cached quotes are compared pairwise,
  exchanges differing, ordered (buy, sell), keeping those with
  spread >= min, profit >= min and buyAsk * quantity <= max (F3);
* the best opportunity per pair wins, first in cache-key order on ties
  (exchange ids compared as strings: "2" < "23" < "6");
* each (pair, buy, sell) executes once; a global trading budget clips the
  quantity of the execution that crosses it and stops later ones.
Only the ticked pair can change the outcome of a tick, so ticks are
independent rows and the global state reduces to a first-occurrence
aggregate plus a running sum.

Plan: ticks are hash-partitioned by (pair, block) with ``block = seq div
block_size``; the exchange list of each pair is broadcast (checked size) to
form the per-tick grid; the as-of fill is a window per (pair, exchange,
block) plus a carry-in from earlier blocks. Window partitions are therefore
bounded by the block size even when one pair has a third of all ticks, and
the grid, window and per-tick collapse share one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions.pairs import exchange_name
from quoteflow.operators.running import DEFAULT_BLOCK, block_of, prefix_sum
from quoteflow.plans.joins import bounded, cache_small, join_small
from quoteflow.session import checkpoint_dir

QUOTE_FIELDS = ["bp", "bs", "ap", "as"]
#: Blocks a span of the carry prefix.
SPAN = 1024
BUDGET = "decimal(38,10)"


@dataclass(frozen=True)
class TradingParams:
    min_spread: float
    min_profit: float
    max_transaction_value: float
    max_trading_value: float


def _quote_struct() -> F.Column:
    return F.struct(F.col("seq").alias("q_seq"), *[F.col(c) for c in QUOTE_FIELDS])


def latest_quote_grid(ticks: DataFrame, block_size: int = DEFAULT_BLOCK, book: DataFrame | None = None) -> DataFrame:
    """For every tick, the latest quote (seq <= tick seq) of each
    exchange of the tick's pair that has quoted so far. ``book`` (pair, x, q_seq and the quote)
    holds the quotes of earlier ticks, at most one per pair and exchange."""
    t = ticks.withColumn("block", block_of("seq", block_size))

    # One aggregate pass over the ticks gives the last quote of each (pair,
    # venue, block); the venue list and the block list derive from it, so the
    # tick scan is read twice in total (this pass and the grid). The result
    # (X * pairs * blocks rows) is checkpointed to the shared folder: read by
    # three branches, held in no executor's memory, safe on executor loss.
    checkpoint_dir(t.sparkSession)
    last_in_block = t.groupBy("pair", "x", "block").agg(F.max(_quote_struct()).alias("last_q"))
    if book is not None:                                     # as a block before all others
        last_in_block = last_in_block.unionByName(book.select(
            "pair", "x", F.lit(-1).cast("bigint").alias("block"), F.struct("q_seq", *QUOTE_FIELDS).alias("last_q")))
    last_in_block = last_in_block.checkpoint(eager=True)
    pair_ex, small = bounded(last_in_block.select("pair", "x").distinct())   # checked once, used twice
    pair_ex = F.broadcast(pair_ex) if small else pair_ex

    # Carry-in: last quote of (pair, x) in blocks before each block, as one
    # row per (pair, block) holding a venue -> quote map (at most X entries).
    # Keyed like the grid's partitioning, so even a carry too big to broadcast
    # joins without moving the grid.
    blocks = last_in_block.select("pair", "block").distinct()
    # The prefix has two levels, so no window holds more than SPAN blocks of a pair and venue, or its
    # spans: quotes grow with q_seq, so the latest is the largest.
    carry = blocks.join(pair_ex, "pair").join(last_in_block, ["pair", "x", "block"], "left")
    carry = carry.withColumn("span", F.expr(f"floor(block / {SPAN})"))
    ws = Window.partitionBy("pair", "x").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = carry.groupBy("pair", "x", "span").agg(F.max("last_q").alias("span_q")).select(
        "pair", "x", "span", F.max("span_q").over(ws).alias("span_q"))
    wb = Window.partitionBy("pair", "x", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("in_span", F.max("last_q").over(wb)).join(spans, ["pair", "x", "span"])
    carry = carry.select("pair", "x", "block", F.coalesce("in_span", "span_q").alias("carry_q"))
    carry = carry.where(F.col("carry_q").isNotNull()).groupBy("pair", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("x", "carry_q"))).alias("carry"))

    grid = (t.select("pair", "block", "seq", F.col("x").alias("tick_x"), _quote_struct().alias("own"))
            .repartition("pair", "block"))
    grid = grid.join(pair_ex, "pair")
    w = Window.partitionBy("pair", "x", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn(
        "in_block", F.last(F.when(F.col("tick_x") == F.col("x"), F.col("own")), ignorenulls=True).over(w))
    grid = join_small(grid, carry, ["pair", "block"], "left")
    grid = grid.withColumn("q", F.coalesce("in_block", F.try_element_at("carry", F.col("x"))))
    grid = grid.where(F.col("q").isNotNull())
    return grid.select("pair", "block", "seq", "x", "q.q_seq", *[F.col(f"q.{c}").alias(c) for c in QUOTE_FIELDS])


def book_after(ticks: DataFrame, book: DataFrame) -> DataFrame:
    """The latest quote per (pair, venue) after ``ticks``, from the ``book`` before them."""
    quote = F.struct("q_seq", *QUOTE_FIELDS)
    seen = ticks.select("pair", "x", F.col("seq").alias("q_seq"), *QUOTE_FIELDS)
    return seen.unionByName(book.select(*seen.columns)).groupBy("pair", "x").agg(F.max(quote).alias("q")).select("pair", "x", "q.*")


def _order_books(grid: DataFrame, keys=("pair", "block", "seq")) -> DataFrame:
    """One row per tick with its pair's cached quotes (at most one per exchange)."""
    return grid.groupBy(*keys).agg(F.collect_list(F.struct("x", *QUOTE_FIELDS)).alias("book"))


def _thr(v) -> F.Column:
    """A threshold: a fixed number, or a per-row column (parameter updates)."""
    return v if isinstance(v, F.Column) else F.lit(float(v))


def _candidates(book: F.Column, p: TradingParams) -> F.Column:
    """J2 + F3 in-row: every ordered (buy, sell) of the book passing the thresholds."""
    combos = F.flatten(F.transform(book, lambda b: F.transform(book, lambda s: F.struct(
        b["x"].alias("buy_x"), s["x"].alias("sell_x"),
        b["ap"].alias("buy_price"), s["bp"].alias("sell_price"),
        F.least(b["as"], s["bs"]).alias("quantity")))))
    combos = F.transform(combos, lambda o: o.withField(
        "profit", (o["sell_price"] - o["buy_price"]) * o["quantity"]))
    return F.filter(combos, lambda o: (o["buy_x"] != o["sell_x"])
                    & (o["sell_price"] - o["buy_price"] >= _thr(p.min_spread))
                    & (o["profit"] >= _thr(p.min_profit))
                    & (o["buy_price"] * o["quantity"] <= _thr(p.max_transaction_value)))


OPP_COLUMNS = ["pair", "seq", "buy_x", "sell_x", "buy_price", "sell_price", "quantity", "profit"]


def opportunities(grid: DataFrame, params: TradingParams) -> DataFrame:
    """All qualifying (buy, sell) opportunities of every tick."""
    b = _order_books(grid).select("pair", "block", "seq", F.explode(_candidates(F.col("book"), params)).alias("o"))
    return b.select("pair", "block", "seq", "o.*").select("block", *OPP_COLUMNS)


def _best_of_books(books: DataFrame, params: TradingParams, keys) -> DataFrame:
    def cmp(l, r):
        ls, rs = l["buy_x"].cast("string"), r["buy_x"].cast("string")
        lt, rt = l["sell_x"].cast("string"), r["sell_x"].cast("string")
        return (F.when(l["profit"] > r["profit"], -1).when(l["profit"] < r["profit"], 1)
                .when(ls < rs, -1).when(ls > rs, 1)
                .when(lt < rt, -1).when(lt > rt, 1).otherwise(0))
    b = books.select(*keys, F.array_sort(_candidates(F.col("book"), params), cmp).alias("opps"))
    b = b.where(F.size("opps") > 0).select(*keys, F.element_at("opps", 1).alias("o"))
    return b.select(*keys, "o.*")


def best_opportunity(grid: DataFrame, params: TradingParams) -> DataFrame:
    """The best opportunity of each tick, ties to the first in
    cache-key order (buy id, then sell id, compared as strings)."""
    keys = ("pair", "block", "seq")
    return _best_of_books(_order_books(grid, keys), params, keys).select("block", *OPP_COLUMNS)


def executed_opportunities(best: DataFrame, params: TradingParams,
                           block_size: int = DEFAULT_BLOCK, spent=None, order=("seq",)) -> DataFrame:
    """W3 + W4 + J4: once-only per (pair, buy, sell) and the global budget.

    First occurrence per key is a partial/final ``min(struct(seq, ...))``
    aggregate (no per-key sort); the budget is a blocked running sum of the
    candidates' buy value, so no window runs in one task. ``spent`` is budget
    already used before these candidates (the streaming sink's carry);
    ``order`` must start with seq (several pairs evaluated at one tick are
    taken in pair order, as the reference folds over pairs).
    """
    cand = best.where(F.col("quantity") > 0)
    firsts = cand.groupBy("pair", "buy_x", "sell_x").agg(
        F.min(F.struct("seq", "buy_price", "sell_price", "quantity")).alias("f"))
    # one row per (pair, buy, sell): small, and read by both branches of the
    # blocked running sum, so it is computed once
    firsts = cache_small(firsts.select("pair", "buy_x", "sell_x", "f.*"))
    # Budget arithmetic in exact decimals: the running total then does not
    # depend on summation order (blocks, engines, retries).
    firsts = firsts.withColumn("value_dec", (F.col("buy_price") * F.col("quantity")).cast(BUDGET))
    run = prefix_sum(firsts, "value_dec", list(order), "prior_dec", block_size=block_size)
    if spent is not None:
        run = run.withColumn("prior_dec", (F.col("prior_dec") + F.lit(spent).cast(BUDGET)).cast(BUDGET))
    run = run.withColumn("prior_value", F.col("prior_dec").cast("double"))
    max_tv = float(params.max_trading_value)
    final_qty = F.when(F.col("prior_dec") + F.col("value_dec") > F.lit(max_tv).cast(BUDGET),
                       (F.lit(max_tv) - F.col("prior_value")) / F.col("buy_price")).otherwise(F.col("quantity"))
    run = run.withColumn("final_qty", final_qty).where(F.col("final_qty") > 0)
    return run.select(
        "pair", "seq", "buy_x", "sell_x",
        exchange_name(F.col("buy_x")).alias("buy_exchange"),
        exchange_name(F.col("sell_x")).alias("sell_exchange"),
        "buy_price", "sell_price",
        F.col("final_qty").alias("quantity"),
        (F.col("buy_price") * F.col("final_qty")).alias("value"),
        "prior_value")


@dataclass(frozen=True)
class TradingCarry:
    """What earlier ticks leave to later ones: the latest quote per pair and exchange (pair, x, q_seq and
    the quote), the executed keys (pair, buy_x, sell_x), the spent budget, and the update in force
    when the last tick was evaluated."""
    book: DataFrame | None = None
    done: DataFrame | None = None
    spent: Decimal = Decimal(0)
    params_seq: int | None = None


def executed_with_updates(ticks: DataFrame, params: DataFrame, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """ST3 / H4 in batch: execution under effective-dated parameter updates
    (``executed_in_segments`` over all ticks at once)."""
    return executed_in_segments(ticks, params, TradingCarry(), block_size)[0]


def executed_in_segments(ticks: DataFrame, params: DataFrame, carry: TradingCarry,
                         block_size: int = DEFAULT_BLOCK) -> tuple[DataFrame, TradingCarry]:
    """ST3 / ST6: the executions of ``ticks`` after what ``carry`` holds, and the carry after them, so that
    any cut of the ticks into batches gives the same executions.

    ``params``: (effective_seq, min_spread, min_profit, max_transaction_value,
    max_trading_value, trading_active); an update applies before the first
    tick with seq >= effective_seq, of equal ones the last in column order. They cut the ticks into segments.
    Semantics of the reference loop:
    * before any parameters exist ticks update the cache but nothing is
      evaluated; while trading is stopped (``trading_active`` false) ticks
      are not processed at all and the cache keeps its older quotes;
    * at the first tick after an update every cached pair is evaluated (in
      pair order); later ticks only change the ticked pair;
    * the spent budget and the once-only keys carry across updates.
    Plan: one pass computes every tick's best under its segment's thresholds
    (joined as columns from the update table, one row an update) and the all-pair
    evaluation at each update; these reduce to the first occurrence of each
    (segment, pair, buy, sell), a table bounded by segments x keys. Only that
    small table is walked segment by segment for budget and once-only.
    """
    spark = ticks.sparkSession
    bounds = ticks.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if bounds["lo"] is None:
        return spark.createDataFrame([], EXECUTED_COLUMNS), carry
    cols = ["effective_seq", "min_spread", "min_profit", "max_transaction_value", "max_trading_value", "trading_active"]
    ups = params.where(F.col("effective_seq") <= bounds["hi"]).select(*cols).orderBy(*cols).collect()   # one row an update
    before = [u for u in ups if u.effective_seq <= bounds["lo"]][-1:]
    ups = before + [u for u in ups if u.effective_seq > bounds["lo"]]
    active = [i for i, u in enumerate(ups) if u.trading_active]
    starts = F.lit([int(u.effective_seq) for u in ups]) if ups else None
    seg = F.size(F.filter(starts, lambda e: e <= F.col("seq"))) - 1 if ups else F.lit(-1)
    t = ticks.withColumn("seg", seg).where(F.col("seg").isin([-1] + active))   # stopped ticks are never seen

    quote = F.struct("q_seq", *QUOTE_FIELDS)
    seen = t.select("pair", "x", "seg", F.col("seq").alias("q_seq"), *QUOTE_FIELDS)
    if carry.book is not None:
        seen = seen.unionByName(carry.book.select("pair", "x", F.lit(-2).alias("seg"), "q_seq", *QUOTE_FIELDS))
    # the latest quote of each (pair, venue) in each segment, of earlier batches at -2
    last_seg = cache_small(seen.groupBy("pair", "x", "seg").agg(F.max(quote).alias("q")))
    book = last_seg.groupBy("pair", "x").agg(F.max("q").alias("q")).select("pair", "x", "q.*")
    first = t.where(F.col("seg") >= 0).groupBy("seg").agg(F.min(F.struct("seq", "pair")).alias("f"))
    first = sorted((r["seg"], r["f"]["seq"], r["f"]["pair"]) for r in first.collect())     # one row a segment
    if not first:
        return spark.createDataFrame([], EXECUTED_COLUMNS), TradingCarry(book, carry.done, carry.spent, carry.params_seq)

    seg_params = F.broadcast(spark.createDataFrame(
        [(i, float(ups[i].min_spread), float(ups[i].min_profit), float(ups[i].max_transaction_value))
         for i in active], "seg int, p_spread double, p_profit double, p_tx double"))
    col_params = TradingParams(F.col("p_spread"), F.col("p_profit"), F.col("p_tx"), 0.0)
    grid = latest_quote_grid(t.drop("seg"), block_size, carry.book).withColumn("seg", seg)
    keys = ("pair", "block", "seq", "seg")
    books = _order_books(grid.where(F.col("seg") >= 0), keys).join(seg_params, "seg")
    cand = _best_of_books(books, col_params, keys)

    # The all-pair evaluation at each new segment's first tick, from the quotes before it: per (pair,
    # venue) one row a segment, and a running latest over them (pairs x venues x segments rows).
    fresh = [(i, s, p) for i, s, p in first if ups[i].effective_seq != carry.params_seq]
    if fresh:
        marks = spark.createDataFrame(fresh, "seg int, seq bigint, first_pair string")
        slots = last_seg.select("pair", "x").distinct().select(
            "pair", "x", F.explode(F.lit([i for i, _, _ in fresh])).alias("seg"), F.lit(True).alias("asked"))
        known = last_seg.join(slots, ["pair", "x", "seg"], "full_outer")
        w = Window.partitionBy("pair", "x").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        known = known.withColumn("q", F.max("q").over(w)).where(F.col("asked") & F.col("q").isNotNull())
        known = known.join(F.broadcast(marks), "seg").where(F.col("pair") != F.col("first_pair"))
        known = known.select("seg", "pair", "x", "seq", F.lit(0).cast("bigint").alias("block"), "q.*")
        vbooks = _order_books(known, keys).join(seg_params, "seg")
        cand = cand.unionByName(_best_of_books(vbooks, col_params, keys))

    firsts = cache_small(cand.where(F.col("quantity") > 0).groupBy("seg", "pair", "buy_x", "sell_x").agg(
        F.min(F.struct("seq", "buy_price", "sell_price", "quantity", "profit")).alias("f"))
        .select("seg", "pair", "buy_x", "sell_x", "f.*"))
    out, done, spent = None, carry.done, carry.spent
    for i in sorted(r["seg"] for r in firsts.select("seg").distinct().collect()):
        u = ups[i]
        tp = TradingParams(u.min_spread, u.min_profit, u.max_transaction_value, u.max_trading_value)
        c = firsts.where(F.col("seg") == i).drop("seg")
        if done is not None:
            c = c.join(done, ["pair", "buy_x", "sell_x"], "left_anti")
        ex = executed_opportunities(c, tp, block_size, spent=str(spent), order=("seq", "pair"))
        ex = ex.checkpoint(eager=True)                   # small; cuts the lineage that grows per segment
        keys_i = ex.select("pair", "buy_x", "sell_x")
        done = keys_i if done is None else done.unionByName(keys_i)
        add = ex.agg(F.sum((F.col("buy_price") * F.col("quantity")).cast(BUDGET))).first()[0]
        spent += add if add is not None else 0
        out = ex if out is None else out.unionByName(ex)
    out = spark.createDataFrame([], EXECUTED_COLUMNS) if out is None else out
    return out, TradingCarry(book, done, spent, int(ups[first[-1][0]].effective_seq))


EXECUTED_COLUMNS = ("pair string, seq bigint, buy_x int, sell_x int, buy_exchange string, sell_exchange string, "
                    "buy_price double, sell_price double, quantity double, value double, prior_value double")
