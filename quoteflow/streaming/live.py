"""Structured Streaming forms of the live paths (ST1-ST6).

ST1  keyed latest-quote state: the book (latest quote per pair and venue) goes from
     micro-batch to micro-batch as a table; a batch is the batch operator over its ticks.
ST2  once-only and budget across pairs: ``foreachBatch`` runs the batch
     execution operator on the micro-batch's ticks; executed keys, the book and the
     spent budget live in tables (never in operator state, so they do not
     grow it), written idempotently by batch id.
ST3  parameters: an effective-dated parameter table cuts every batch into segments.
ST4  P&L: one position per pair goes from batch to batch as a table, and the fold goes on from
     it in sorted partitions; ``PortfolioSink`` carries the portfolio running
     total and the command in force, and alerts each threshold command once (W5/W6).
ST5  5 ms buckets of the historical scan with a watermark (added capability).
ST6  stop: ``query.stop()``, or an effective-dated parameter row that is not active, at its
     tick; the P&L gate acts from the alert's time on.

State is in tables and not in a keyed state operator because trades and ticks of a key must be taken in
order, and a micro-batch's rows of a key can be neither sorted nor split over tasks inside one. Only ST4 runs
Python (Arrow batches). The last arrival wins in ST1 whatever its timestamp (no lateness rule), like the reference.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators import opportunities as OPS
from quoteflow.operators import pnl as PNL
from quoteflow.operators.running import global_prefix_sum
from quoteflow.plans.joins import release_cached
from quoteflow.session import date_in_order, delete_path, path_exists, scratch_path

# ----------------------------------------------------------------- sources


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream over one driver table (a glob matching exactly that file)."""
    path = os.path.join(sf_dir, f"[{name[0]}]{name[1:]}.parquet")
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def land_in_order(rows: DataFrame, order: str | list, path: str, n: int) -> None:
    """Land rows as ``n`` files of about as many rows each, consecutive ranges of ``order`` (columns or
    expressions), dated one after the other, as a feed would. Rows without the first of ``order`` don't land.

    The files are range partitions, written in one pass by as many tasks; rows of equal ``order`` are in one file, so
    every cut between files is a cut of the order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, str) else order)]
    rows.where(keys[0].isNotNull()).repartitionByRange(n, *keys).write.mode("overwrite").parquet(path)
    date_in_order(rows.sparkSession, path)


def landed_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream over what ``land_in_order`` wrote, oldest first, ``files`` files a micro-batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
            .option("recursiveFileLookup", True).parquet(path))


# --------------------------------------------------------------------- ST1
GRID_SCHEMA = T.StructType([
    T.StructField("pair", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("q_seq", T.LongType()),
    T.StructField("bp", T.DoubleType()),
    T.StructField("bs", T.DoubleType()),
    T.StructField("ap", T.DoubleType()),
    T.StructField("as", T.DoubleType()),
])

# --------------------------------------------------------------- ST2 / ST3
EXECUTED_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("pair", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("buy_x", T.IntegerType()),
    T.StructField("sell_x", T.IntegerType()),
    T.StructField("buy_exchange", T.StringType()),
    T.StructField("sell_exchange", T.StringType()),
    T.StructField("buy_price", T.DoubleType()),
    T.StructField("sell_price", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("prior_value", T.DoubleType()),
    T.StructField("value_dec", T.DecimalType(38, 10)),
    T.StructField("orders_submitted", T.BooleanType()),
])

PARAMS_SCHEMA = T.StructType([
    T.StructField("effective_seq", T.LongType()),
    T.StructField("min_spread", T.DoubleType()),
    T.StructField("min_profit", T.DoubleType()),
    T.StructField("max_transaction_value", T.DoubleType()),
    T.StructField("max_trading_value", T.DoubleType()),
    T.StructField("trading_active", T.BooleanType()),
])

# latest quote per (pair, venue) after a batch: the cache, at most X rows a pair
BOOK_SCHEMA = T.StructType([T.StructField("pair", T.StringType()), T.StructField("x", T.IntegerType())]
                           + [f for f in GRID_SCHEMA.fields if f.name in ("q_seq", "bp", "bs", "ap", "as")])
META_SCHEMA = T.StructType([
    T.StructField("params_seq", T.LongType()),
    T.StructField("spent", T.DecimalType(38, 10)),
    T.StructField("book_batch", T.LongType()),
])


def read_written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not have been written yet. Only a path that isn't there is an empty
    table; any other failure is raised."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def write_params(spark: SparkSession, path: str, effective_seq: int, p: OPS.TradingParams,
                 trading_active: bool = True) -> None:
    """ST3 / ST6: append an effective-dated parameter row. ``trading_active``
    false means trading is stopped: ticks are not processed at all."""
    spark.createDataFrame([(int(effective_seq), p.min_spread, p.min_profit, p.max_transaction_value,
                            p.max_trading_value, bool(trading_active))], PARAMS_SCHEMA) \
        .write.mode("append").parquet(path)


class BatchSink:
    """A ``foreachBatch`` sink whose micro-batches take effect once, whatever is replayed.

    ``process`` writes into ``batch_id=<id>`` folders with overwrite; the batch is committed
    by its meta row, written last. The next batch reads only that row and the tables that it names. What a committed
    batch has replaced (returned by ``process``) and the meta row before are deleted."""

    meta_schema: T.StructType

    def __init__(self, path: str):
        self.path, self.meta_path = path, path + "-meta"

    @staticmethod
    def _part(path: str, batch_id: int) -> str:
        return os.path.join(path, f"batch_id={batch_id}")

    def _state(self, spark, name: str, schema: T.StructType, batch_id: int | None) -> DataFrame:
        """A carried table as ``batch_id`` wrote it; empty without one."""
        if batch_id is None:
            return spark.createDataFrame([], schema)
        return read_written(spark, self._part(f"{self.path}-{name}", batch_id), schema)

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if read_written(spark, self._part(self.meta_path, batch_id), self.meta_schema).limit(1).count():
            return                                          # batch already committed
        meta = read_written(spark, self._part(self.meta_path, batch_id - 1), self.meta_schema).first()
        rows = rows.persist()                               # used by several actions
        try:
            new, replaced = self.process(spark, rows, batch_id, meta)
        finally:
            rows.unpersist()
            release_cached()
        spark.createDataFrame([new], self.meta_schema).write.mode("overwrite").parquet(self._part(self.meta_path, batch_id))
        for path in [*replaced, self._part(self.meta_path, batch_id - 1)]:
            delete_path(spark, path)

    def process(self, spark, rows: DataFrame, batch_id: int, meta) -> tuple[tuple, list[str]]:
        """Write the batch; gives its meta row and the paths that no one reads once it is committed."""
        raise NotImplementedError

    def _carry(self, table: DataFrame, name: str, batch_id: int, last: int | None) -> list[str]:
        """Write a carried table; gives the folder that it replaces."""
        table.write.mode("overwrite").parquet(self._part(f"{self.path}-{name}", batch_id))
        return [] if last is None else [self._part(f"{self.path}-{name}", last)]


def start_sink(spark: SparkSession, rows: DataFrame, sink, name: str, trigger: dict | None = None):
    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


# --------------------------------------------------------------------- ST1
class GridSink(BatchSink):
    """ST1: every tick with the latest quote of each exchange of its pair. The state is the book, one
    quote per (pair, venue), a table that the next batch starts from; a batch is the batch operator's window by
    (pair, venue, block), so a pair that fills a batch is spread over tasks and none holds it."""

    meta_schema = T.StructType([T.StructField("book_batch", T.LongType())])

    def process(self, spark, rows, batch_id, meta):
        last = meta["book_batch"] if meta is not None else None
        if not rows.limit(1).count():
            return (last,), []
        book = self._state(spark, "book", BOOK_SCHEMA, last)
        grid = OPS.latest_quote_grid(rows, book=book).select(*GRID_SCHEMA.fieldNames())
        grid.write.mode("overwrite").parquet(self._part(self.path, batch_id))
        return (batch_id,), self._carry(OPS.book_after(rows, book), "book", batch_id, last)


def start_quote_grid(spark: SparkSession, ticks: DataFrame, name: str = "grid", trigger: dict | None = None):
    """ST1 as a streaming query: (query, path of the grid)."""
    path = scratch_path(spark, name)
    rows = ticks.select("pair", "seq", "x", "bp", "bs", "ap", "as")
    return start_sink(spark, rows, GridSink(path), name, trigger), path


class ExecutionSink(BatchSink):
    """ST2 / ST3 / ST6 over ticks: each pair's best opportunity is executed
    once, within the global budget, across micro-batches.

    A micro-batch is run by ``executed_in_segments``: parameter updates and stops take effect at their
    tick, within the batch too, so how the ticks are cut into batches changes nothing. Between batches
    go the book (latest quote per pair and venue), the executed keys, the spent budget and the update in force.
    * An update must be in the parameter table when the first tick it applies to is read.
    * P&L gate (an alert of the portfolio sink): executions from the alert's time on are still
      recorded and still spend the budget and the once-only mark (Q9), but
      with ``orders_submitted`` false.
    """

    meta_schema = META_SCHEMA

    def __init__(self, executed_path: str, params_path: str, alerts_path: str | None = None):
        super().__init__(executed_path)
        self.params_path, self.alerts_path = params_path, alerts_path

    def process(self, spark, rows, batch_id, meta):
        executed = read_written(spark, self.path, EXECUTED_SCHEMA).where(F.col("batch_id") != batch_id)
        done, last = executed.select("pair", "buy_x", "sell_x"), None
        carry = OPS.TradingCarry(done=done)
        if meta is not None:
            last = meta["book_batch"]
            book = None if last is None else self._state(spark, "book", BOOK_SCHEMA, last)
            carry = OPS.TradingCarry(book, done, meta["spent"], meta["params_seq"])
        ex, after = OPS.executed_in_segments(rows, read_written(spark, self.params_path, PARAMS_SCHEMA), carry)
        replaced, book_batch = [], last
        if after.book is not None and after.book is not carry.book:
            replaced, book_batch = self._carry(after.book, "book", batch_id, last), batch_id

        closed = None if not self.alerts_path else read_written(
            spark, self.alerts_path, ALERT_SCHEMA).agg(F.min("alert_ts")).first()[0]
        submitted = F.lit(True)
        if closed is not None:
            # the few executions look up their tick's time
            ex = rows.select("seq", "t").join(F.broadcast(ex), "seq")
            submitted = F.timestamp_millis("t").cast("timestamp_ntz") < F.lit(closed)
        ex = ex.withColumn("value_dec", (F.col("buy_price") * F.col("quantity")).cast("decimal(38,10)")) \
            .withColumn("orders_submitted", submitted)
        # only batches with executions get a folder: the table read by every
        # batch stays bounded by the opportunity keys, not by the batch count
        ex = ex.select(*[c.name for c in EXECUTED_SCHEMA.fields[1:]]).persist()
        if ex.limit(1).count():
            ex.write.mode("overwrite").parquet(self._part(self.path, batch_id))
        ex.unpersist()
        return (after.params_seq, Decimal(after.spent), book_batch), replaced


def start_live_trading(spark: SparkSession, ticks: DataFrame, params_path: str, name: str = "live",
                       trigger: dict | None = None, alerts_path: str | None = None):
    """Ticks -> ST2 as one streaming query; returns (query, executed_path).
    ``query.stop()`` or a parameter row that is not active is the stop-trading operation (ST6);
    ``alerts_path`` (the portfolio sink's alert table) closes the gate once a threshold is hit."""
    executed = scratch_path(spark, f"{name}-executed")
    rows = ticks.select("pair", "seq", "x", "bp", "bs", "ap", "as", "t")
    return start_sink(spark, rows, ExecutionSink(executed, params_path, alerts_path), name, trigger), executed


# --------------------------------------------------------------------- ST4
class PnlSink(BatchSink):
    """ST4: the weighted-average-cost fold over trades that arrive in (ts, order_id) order. The state is one
    position per pair, a table; a batch is folded on from it in sorted partitions, so a task holds one Arrow batch and
    one position however many trades a pair brings. Writes the batch fold's per-trade rows; ``then``, if
    given, is called with the batch's written rows."""

    meta_schema = T.StructType([T.StructField("positions_batch", T.LongType())])

    def __init__(self, path: str, then=None):
        super().__init__(path)
        self.then = then

    def process(self, spark, rows, batch_id, meta):
        last, part = meta["positions_batch"] if meta is not None else None, self._part(self.path, batch_id)
        if not rows.limit(1).count():
            return (last,), []
        positions = self._state(spark, "positions", PNL.POSITION_SCHEMA, last)
        onwards = PNL.fold_onwards(rows, positions)
        onwards.withColumn("is_state", F.col("state_n").isNotNull()) \
            .write.mode("overwrite").partitionBy("is_state").parquet(part)
        written = spark.read.schema(onwards.schema).parquet(part)
        after = PNL.positions_after(written)
        kept = positions.join(after.select("pair"), "pair", "left_anti").unionByName(after)
        replaced = self._carry(kept, "positions", batch_id, last)
        if self.then is not None:
            self.then(written.where("state_n IS NULL").select(*PNL.FOLD_SCHEMA.fieldNames()), batch_id)
        return (batch_id,), replaced


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """The per-trade rows that a ``PnlSink`` has written."""
    schema = T.StructType(PNL.FOLD_SCHEMA.fields + [T.StructField("is_state", T.BooleanType())])
    return read_written(spark, path, schema).where("NOT is_state").select(*PNL.FOLD_SCHEMA.fieldNames()) \
        .withColumn("pnl", F.col("delta").cast(PNL.PNL))


def start_pnl(spark: SparkSession, trades: DataFrame, name: str = "pnl", then=None, trigger: dict | None = None):
    """ST4 as a streaming query: (query, path for ``read_folded``)."""
    path = scratch_path(spark, name)
    return start_sink(spark, trades, PnlSink(path, then), name, trigger), path


# --------------------------------------------------------------------- ST5
def stream_bucket_representatives(quotes: DataFrame, bucket_ms: int, watermark: str) -> DataFrame:
    """ST5: per (bucket, pair, exchange) best-bid representative over a
    tumbling event-time window; rows are final once the watermark passes the
    bucket end, and all exchanges of a bucket close in the same micro-batch."""
    q = quotes.withColumn("event_time", F.timestamp_millis("t")).withWatermark("event_time", watermark)
    g = q.groupBy(F.window("event_time", f"{int(bucket_ms)} milliseconds").alias("w"), "pair", "x").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.min("seq").alias("first_seq"),
        F.max(F.struct(F.col("bp"), (-F.col("seq")).alias("neg_seq"), F.col("ap"))).alias("best"))
    return g.select(F.col("w.start").alias("bucket_start"), "pair", "x", "n_quotes", "first_seq",
                    F.col("best.bp").alias("bp"), F.col("best.ap").alias("ap"))


class BucketFlagSink:
    """ST5 finishing step (foreachBatch): closed buckets' (bucket, pair) flags,
    appended idempotently; the report is a sum over the table."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, reps: DataFrame, batch_id: int) -> None:
        g = reps.groupBy("bucket_start", "pair").agg(
            F.sum("n_quotes").alias("n_quotes"), F.min("first_seq").alias("pair_first_seq"),
            F.max("bp").alias("max_bid"), F.min("ap").alias("min_ask"))
        g = g.withColumn("flag", (F.col("max_bid") - F.col("min_ask") > F.lit("0.01").cast("decimal(3,2)")).cast("int"))
        g.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite") \
            .parquet(os.path.join(self.path, f"batch={batch_id}"))


def bucket_report(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.parquet(path).where(F.col("n_quotes") > 1)
    return f.groupBy("pair").agg(F.sum("flag").cast("bigint").alias("opportunities")) \
        .where(F.col("opportunities") != 0)


# ------------------------------------------------ ST4 portfolio sink
CUM_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("order_id", T.StringType()), T.StructField("pair", T.StringType()),
    T.StructField("pnl", PNL.PNL), T.StructField("cum_pnl", PNL.PNL),
])
ALERT_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("command_id", T.LongType()),
    T.StructField("alert_ts", T.TimestampNTZType()), T.StructField("alert_order_id", T.StringType()),
    T.StructField("alert_cum_pnl", PNL.PNL),
])


#: The threshold command in force after a batch, and the latest trade time.
FORCE = "command_id long, ts timestamp_ntz, threshold decimal(18,2)"


class PortfolioSink(BatchSink):
    """ST4 finishing step: running portfolio P&L across micro-batches (W5) and the first
    crossing of each threshold command (W6), over folded trades in (ts, order_id) order.

    Between batches go the last cumulative value, the latest trade time and the one command in
    force (null once it has alerted). A batch reads the commands between the last batch's latest time and its own,
    a range that reaches the commands' scan, so its cost doesn't grow with past trades or commands. A
    command must be in the table when the first trade at or after it is read."""

    meta_schema = T.StructType([
        T.StructField("cum_pnl", PNL.PNL), T.StructField("until", T.TimestampNTZType()),
        T.StructField("command_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("threshold", T.DecimalType(18, 2)),
    ])

    def __init__(self, cum_path: str, alerts_path: str, commands: DataFrame):
        super().__init__(cum_path)
        self.cum_path, self.alerts_path, self.commands = cum_path, alerts_path, commands

    def process(self, spark, rows, batch_id, meta):
        if not rows.limit(1).count():
            return tuple(meta) if meta is not None else (Decimal(0), None, None, None, None), []
        carry = meta["cum_pnl"] if meta is not None else Decimal(0)
        trades = rows.select("ts", "order_id", "pair", F.col("delta").cast(PNL.PNL).alias("pnl"))
        cum = global_prefix_sum(trades, "pnl", PNL.TRADE_ORDER, "cum_pnl", inclusive=True)
        cum = cum.withColumn("cum_pnl", (F.col("cum_pnl") + F.lit(carry).cast(PNL.PNL)).cast(PNL.PNL))
        cum.select("ts", "order_id", "pair", "pnl", "cum_pnl").write.mode("overwrite").parquet(self._part(self.path, batch_id))
        written = spark.read.parquet(self._part(self.path, batch_id))
        last = written.agg(F.max(F.struct("ts", "order_id", "cum_pnl")).alias("m")).first()["m"]

        new = self.commands.where(F.col("ts") <= F.lit(last["ts"]))
        if meta is not None and meta["until"] is not None:
            new = new.where(F.col("ts") > F.lit(meta["until"]))
        new = new.select(F.col("command_id").cast("long").alias("command_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                         F.col("threshold").cast("decimal(18,2)").alias("threshold")).where("threshold >= 0")
        held = [] if meta is None or meta["command_id"] is None else [(meta["command_id"], meta["ts"], meta["threshold"])]
        new = new.unionByName(spark.createDataFrame(held, FORCE)).persist()
        # a written table, as what is in force at the batch's end needs the alerts too
        hits = PNL.threshold_alerts(written, new).where("alert_ts IS NOT NULL").persist()
        if hits.limit(1).count():          # folders only for batches with alerts (bounded by commands)
            hits.select("command_id", "alert_ts", "alert_order_id", "alert_cum_pnl") \
                .write.mode("overwrite").parquet(self._part(self.alerts_path, batch_id))
        force = new.agg(F.max(F.struct("ts", "command_id", "threshold")).alias("f")).first()["f"]
        if force is not None and (force["threshold"] == 0 or hits.where(F.col("command_id") == force["command_id"]).count()):
            force = None
        hits.unpersist()
        new.unpersist()
        row = (None, None, None) if force is None else (force["command_id"], force["ts"], force["threshold"])
        return (last["cum_pnl"], last["ts"], *row), []
