"""Stream = batch: replay driver tables as several ordered files, one per
micro-batch, so keyed state and sink tables carry across batches."""

import os
import tempfile
import time

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quoteflow.operators import history, opportunities as O, pnl
from quoteflow.plans import catalog
from quoteflow.sources import adapters
from quoteflow.streaming import live

N_FILES = 4


def split_table(name, sort_cols, n=N_FILES):
    """Write ``name`` as n files in order (ascending mtime = arrival order).
    Cuts never split equal values of the first sort column, so arrival order
    agrees with any order that starts with it."""
    t = pq.read_table(os.path.join(SF_SMALL, f"{name}.parquet"))
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in sort_cols]))
    first = t.column(sort_cols[0]).to_pylist()
    d = tempfile.mkdtemp(prefix=f"qf-stream-{name}-")
    cuts, step = [0], (t.num_rows + n - 1) // n
    for i in range(1, n):
        c = max(i * step, cuts[-1])
        while 0 < c < t.num_rows and first[c] == first[c - 1]:
            c += 1
        cuts.append(c)
    cuts.append(t.num_rows)
    for i in range(n):
        p = os.path.join(d, f"part-{i:03d}.parquet")
        pq.write_table(t.slice(cuts[i], cuts[i + 1] - cuts[i]), p)
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return d


def stream_of(spark, name, sort_cols):
    d = split_table(name, sort_cols)
    schema = spark.read.parquet(os.path.join(SF_SMALL, f"{name}.parquet")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_st1_grid_stream_equals_batch(spark):
    ticks = adapters.live_quotes_frame(stream_of(spark, "events", ["event_id"]))
    q, out = live.start_quote_grid(spark, ticks, f"grid-{time.time_ns()}")
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= N_FILES - 1
    cols = ["pair", "seq", "x", "q_seq", "bp", "bs", "ap", "as"]
    got = rows(spark.read.parquet(out), cols)
    want = rows(O.latest_quote_grid(adapters.live_quotes(spark, SF_SMALL)), cols)
    assert got == want and len(got) > 0


def test_st2_executions_stream_equal_batch(spark, scratch_dir):
    params = os.path.join(scratch_dir, "params-a")
    live.write_params(spark, params, 0, catalog.LIVE_PARAMS)
    ticks = adapters.live_quotes_frame(stream_of(spark, "events", ["event_id"]))
    q, executed = live.start_live_trading(spark, ticks, params, name=f"t{time.time_ns()}")
    q.awaitTermination()
    cols = ["pair", "seq", "buy_x", "sell_x", "buy_exchange", "sell_exchange", "quantity", "prior_value"]
    got = rows(spark.read.parquet(executed), cols)
    want = rows(catalog.QUERIES["executed_opportunities"](spark, SF_SMALL), cols)
    assert got == want and len(got) > 0
    assert q.lastProgress["batchId"] >= N_FILES - 1  # state crossed micro-batches


def test_st6_gate_stops_trading(spark, scratch_dir):
    params = os.path.join(scratch_dir, "params-b")
    live.write_params(spark, params, 0, catalog.LIVE_PARAMS, trading_active=False)
    ticks = adapters.live_quotes_frame(stream_of(spark, "events", ["event_id"]))
    q, executed = live.start_live_trading(spark, ticks, params, name=f"g{time.time_ns()}")
    q.awaitTermination()
    assert not os.path.exists(executed) or spark.read.parquet(executed).count() == 0


def test_st4_pnl_stream_equals_batch(spark):
    li = stream_of(spark, "lineitem", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    trades = pnl.order_to_trade(pnl.completed_orders(adapters.orders_frame(li)))
    q, out = live.start_pnl(spark, trades, f"pnl-{time.time_ns()}")
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= N_FILES - 1
    cols = ["pair", "order_id", "delta", "quantity", "avg_cost", "has_position"]
    got = rows(live.read_folded(spark, out), cols)
    want = rows(pnl.fold_trades(pnl.order_to_trade(pnl.completed_orders(adapters.orders(spark, SF_SMALL)))), cols)
    assert got == want


def test_st5_bucket_stream_equals_batch_on_closed_buckets(spark, scratch_dir):
    bucket = catalog.HIST_BUCKET_MS
    qs = adapters.quotes_frame(stream_of(spark, "events", ["event_id"]))
    reps = live.stream_bucket_representatives(qs, bucket, "0 seconds")
    path = os.path.join(scratch_dir, f"flags-{time.time_ns()}")
    ck = tempfile.mkdtemp(prefix="qf-ck-")
    q = (reps.writeStream.foreachBatch(live.BucketFlagSink(path)).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.pair: r.opportunities for r in live.bucket_report(spark, path).collect()}
    quotes = adapters.quotes(spark, SF_SMALL)
    last = quotes.agg(F.max(F.expr(f"t div {bucket}"))).first()[0]
    closed = quotes.where(F.expr(f"t div {bucket}") < last)
    want = {r.pair: r.opportunities for r in history.opportunities_per_pair(closed, bucket).collect()}
    assert got == want and len(got) > 0


@pytest.mark.parametrize("name", ["stream_latest_quote_grid", "stream_executed_opportunities",
                                  "stream_pnl_by_pair"])
def test_registered_stream_queries_equal_batch(spark, name):
    batch = name.replace("stream_", "")
    s = catalog.QUERIES[name](spark, SF_SMALL)
    b = catalog.QUERIES[batch](spark, SF_SMALL)
    assert sorted(s.columns) == sorted(b.columns)
    cols = sorted(b.columns)
    assert rows(s, cols) == rows(b, cols)


def test_st3_parameter_change_mid_stream(spark, scratch_dir):
    """Trading is switched off from the third file on: executions stop there."""
    import pyarrow.parquet as pq2
    params = os.path.join(scratch_dir, f"params-{time.time_ns()}")
    d = split_table("events", ["event_id"])
    third = sorted(os.listdir(d))[2]
    cutoff = min(pq2.read_table(os.path.join(d, third), columns=["event_id"]).column(0).to_pylist())
    live.write_params(spark, params, 0, catalog.LIVE_PARAMS)
    live.write_params(spark, params, cutoff, catalog.LIVE_PARAMS, trading_active=False)
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    q, executed = live.start_live_trading(spark, adapters.live_quotes_frame(ev), params, name=f"p{time.time_ns()}")
    q.awaitTermination()
    ex = spark.read.parquet(executed)
    assert ex.count() > 0 and ex.where(F.col("seq") >= cutoff).count() == 0


def test_st4_portfolio_sink_equals_batch(spark, scratch_dir):
    li = stream_of(spark, "lineitem", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    trades = pnl.order_to_trade(pnl.completed_orders(adapters.orders_frame(li)))
    cmds = adapters.threshold_commands(spark, SF_SMALL)
    tag = time.time_ns()
    sink = live.PortfolioSink(os.path.join(scratch_dir, f"cum-{tag}"), os.path.join(scratch_dir, f"alerts-{tag}"), cmds)
    q, _ = live.start_pnl(spark, trades, f"folded-{tag}", then=sink)
    q.awaitTermination()
    cols = ["ts", "order_id", "cum_pnl"]
    got = rows(spark.read.parquet(sink.cum_path), cols)
    want = rows(catalog.QUERIES["cumulative_pnl"](spark, SF_SMALL), cols)
    assert got == want
    acols = ["command_id", "alert_ts", "alert_order_id", "alert_cum_pnl"]
    got_a = rows(spark.read.parquet(sink.alerts_path), acols)
    want_a = rows(catalog.QUERIES["threshold_alert"](spark, SF_SMALL).where("alert_ts IS NOT NULL"), acols)
    assert got_a == want_a


def test_reached_threshold_stops_trading(spark, scratch_dir):
    params = os.path.join(scratch_dir, f"params-{time.time_ns()}")
    alerts = os.path.join(scratch_dir, f"alerts-gate-{time.time_ns()}")
    live.write_params(spark, params, 0, catalog.LIVE_PARAMS)
    import datetime as dt
    from decimal import Decimal
    spark.createDataFrame([(0, 1, dt.datetime(2024, 1, 1), "o1", Decimal("1.0"))], live.ALERT_SCHEMA) \
        .write.parquet(alerts)
    ticks = adapters.live_quotes_frame(stream_of(spark, "events", ["event_id"]))
    q, executed = live.start_live_trading(spark, ticks, params, name=f"a{time.time_ns()}", alerts_path=alerts)
    q.awaitTermination()
    # Q9: opportunities are still marked and the budget spent; only the
    # orders are not submitted
    ex = spark.read.parquet(executed)
    assert ex.count() > 0 and ex.where("orders_submitted").count() == 0
    want = rows(catalog.QUERIES["executed_opportunities"](spark, SF_SMALL), ["pair", "seq", "buy_x", "sell_x"])
    assert rows(ex, ["pair", "seq", "buy_x", "sell_x"]) == want


def test_portfolio_sink_replay_is_idempotent(spark, scratch_dir):
    import datetime as dt
    from decimal import Decimal
    base = dt.datetime(2024, 1, 1)
    folded = spark.createDataFrame(
        [("A", "o1", base, "sell", 10.0, 0.0, 0.0, False), ("A", "o2", base + dt.timedelta(1), "sell", 5.0, 0.0, 0.0, False)],
        pnl.FOLD_SCHEMA)
    cmds = spark.createDataFrame([(1, base, Decimal("12"))], "command_id long, ts timestamp_ntz, threshold decimal(18,2)")
    tag = time.time_ns()
    sink = live.PortfolioSink(os.path.join(scratch_dir, f"c-{tag}"), os.path.join(scratch_dir, f"a-{tag}"), cmds)
    sink(folded, 0)
    sink(folded, 0)                       # replay of the same batch: skipped
    later = spark.createDataFrame([("A", "o3", base + dt.timedelta(2), "sell", 1.0, 0.0, 0.0, False)], pnl.FOLD_SCHEMA)
    sink(later, 1)
    cum = sorted((r.order_id, r.cum_pnl) for r in spark.read.parquet(sink.cum_path).collect())
    assert cum == [("o1", Decimal("10.000000")), ("o2", Decimal("15.000000")), ("o3", Decimal("16.000000"))]
    alerts = spark.read.parquet(sink.alerts_path).collect()
    assert [(a.command_id, a.alert_order_id) for a in alerts] == [(1, "o2")]


def test_st3_parameter_update_reevaluates_every_pair(spark, scratch_dir):
    """A parameter update taking effect at a micro-batch boundary: the sink
    must match the literal loop, which re-evaluates all pairs after it."""
    from test_restatement import live_loop, load_ticks
    import pyarrow.parquet as pq2

    d = split_table("events", ["event_id"])
    third = sorted(os.listdir(d))[2]
    cutoff = min(pq2.read_table(os.path.join(d, third), columns=["event_id"]).column(0).to_pylist())
    p0 = catalog.LIVE_PARAMS
    p1 = O.TradingParams(min_spread=2.0, min_profit=4.0, max_transaction_value=900.0, max_trading_value=9000.0)
    params = os.path.join(scratch_dir, f"params-{time.time_ns()}")
    live.write_params(spark, params, 0, p0)
    live.write_params(spark, params, cutoff, p1)
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    q, executed = live.start_live_trading(spark, adapters.live_quotes_frame(ev), params, name=f"u{time.time_ns()}")
    q.awaitTermination()
    got = sorted((r.pair, r.seq, r.buy_x, r.sell_x, r.quantity) for r in spark.read.parquet(executed).collect())
    want = sorted(live_loop(load_ticks(SF_SMALL), lambda s: p1 if s >= cutoff else p0))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert any(w[1] >= cutoff for w in want)
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("files", [1, 3, 8])
def test_st3_st6_updates_inside_batches(spark, scratch_dir, files):
    """Updates and stops at arbitrary ticks: any number of micro-batches gives the literal loop's executions."""
    from test_restatement import STOPPED, live_loop, load_ticks

    p0 = catalog.LIVE_PARAMS
    p1 = O.TradingParams(min_spread=2.0, min_profit=4.0, max_transaction_value=900.0, max_trading_value=9000.0)
    plan = [(101, p0, True), (333, p0, False), (457, p1, True), (460, p1, False), (461, p0, True), (780, p1, True), (871, p0, True)]
    params = os.path.join(scratch_dir, f"params-{time.time_ns()}")
    for e, p, active in plan:
        live.write_params(spark, params, e, p, active)
    landed = os.path.join(scratch_dir, f"landed-{time.time_ns()}")
    events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    live.land_in_order(events, "event_id", landed, files)
    ticks = adapters.live_quotes_frame(live.landed_stream(spark, landed, events.schema))
    q, executed = live.start_live_trading(spark, ticks, params, name=f"s{time.time_ns()}")
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= files - 1
    now = {"at": None}

    def schedule(seq):
        for e, p, active in plan:
            if seq == e:
                now["at"] = p if active else STOPPED
        return now["at"]

    got = sorted((r.pair, r.seq, r.buy_x, r.sell_x, r.quantity) for r in spark.read.parquet(executed).collect())
    want = sorted(live_loop(load_ticks(SF_SMALL), schedule))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len({w[1] > 457 for w in want}) == 2
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)
    # what a later batch replaced is gone
    assert len(os.listdir(executed + "-meta")) == 1 and len(os.listdir(executed + "-book")) == 1


def test_unreadable_state_is_an_error(spark, scratch_dir):
    """A read that fails is not an empty table: trades would be repeated."""
    path = os.path.join(scratch_dir, f"broken-{time.time_ns()}")
    assert live.read_written(spark, path, live.META_SCHEMA).count() == 0
    os.makedirs(path)
    with open(os.path.join(path, "part-0.parquet"), "wb") as f:
        f.write(b"not a table")
    with pytest.raises(Exception):
        live.read_written(spark, path, live.META_SCHEMA).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_goes_on_from_positions(spark, scratch_dir, seed):
    """Batches of any size, with pairs that come and go: the bits of one fold."""
    import datetime as dt
    import random
    from quoteflow.operators import position

    r = random.Random(seed)
    data = [(f"P{r.randrange(3)}" if i < 250 else "P9", f"o{i:04d}", r.choice(["buy", "buy", "sell"]), r.randrange(0, 90) / 8,
             r.randrange(1, 999) / 16, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(400)]
    schema = "pair string, order_id string, side string, amount double, price double, ts timestamp_ntz"
    sink = live.PnlSink(os.path.join(scratch_dir, f"onwards-{seed}-{time.time_ns()}"))
    cuts = [0, *sorted(r.sample(range(1, 400), 5)), 400]
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        sink(spark.createDataFrame(data[i:j], schema), k)
    sink(spark.createDataFrame([], schema), len(cuts))
    got = rows(live.read_folded(spark, sink.path), ["order_id", "delta", "quantity", "avg_cost", "has_position"])
    loop, want = {}, []
    for p, o, side, amount, price, _ in data:
        pos = loop.setdefault(p, position.Position())
        d, q, c, h = pos.run([side], [round(amount * 10**8)], [price])
        want.append((o, d[0], q[0], c[0], h[0]))
    assert got == want


def test_landing_shares_a_hot_day_and_keeps_the_order(spark, scratch_dir):
    """Files of about as many rows whatever the days hold, dated in order: nine in ten rows are of one day, and some of
    none. Keys of equal order stay in one file."""
    path = os.path.join(scratch_dir, f"hot-{time.time_ns()}")
    data = spark.range(4000).selectExpr("IF(id % 10 = 0, id % 70, 30) AS day", "(id * 7919) % 2000 AS k")
    data = data.unionByName(spark.createDataFrame([(None, 1)], "day long, k long"))
    live.land_in_order(data.repartition(6), ["day", F.expr("lpad(k, 5, '0')")], path, 8)
    files = sorted((os.path.getmtime(f"{path}/{f}"), f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    assert len({m for m, _ in files}) == len(files) == 8
    held = [sorted((r["day"], r["k"]) for r in pq.read_table(f).to_pylist()) for _, f in files]
    assert sum(held, []) == sorted((r.day, r.k) for r in data.where("day IS NOT NULL").collect())
    assert all(a[-1] < b[0] for a, b in zip(held, held[1:]))
    assert max(map(len, held)) < 1000


def test_a_micro_batch_takes_several_landed_files(spark, scratch_dir, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 100)
    path, seen = os.path.join(scratch_dir, f"pieces-{time.time_ns()}"), []
    stream = catalog._landed(spark, spark.range(1000), "id", path)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 12
    q = live.start_sink(spark, stream, lambda b, i: seen.append([r.id for r in b.collect()]), f"pieces{time.time_ns()}")
    q.awaitTermination()
    assert len(seen) == 3 and sum(map(sorted, seen), []) == list(range(1000))
