"""First row at or after a time whose running value reaches a threshold, for many commands.

A two-level index over the rows' range blocks: the maximum of every block, then one block. A
command is looked up in the block where its time begins; if nothing there reaches its threshold before the
command ends, block maxima give the one later block that does, and it is looked up there. So rows are joined
once a level and commands at most twice, however many rows a day has. In a block, a tree of maxima answers
each command in steps that grow with the logarithm of the block. Blocks with many commands are shared by
several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Commands that one task looks up in a block.
COMMANDS_A_TASK = 100_000
#: Values are compared as whole millionths above the block's least, thresholds as far as these reach.
SCALE, FARTHEST = 1_000_000, 9_000_000_000_000
NEVER = (1 << 63) - 1
HITS = "command_id long, alert_ts timestamp_ntz, alert_order_id string, alert_cum_pnl decimal(38,6), on_from long"


def first_at_least(values: np.ndarray, starts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Per query the first index from ``starts`` on whose value is at least ``least``; len(values) if none."""
    size = 1 << max(len(values) - 1, 0).bit_length()
    tree = np.full(2 * size, np.iinfo(np.int64).min, np.int64)
    tree[size:size + len(values)] = values
    half = size
    while half > 1:
        tree[half // 2:half] = np.maximum(tree[half:2 * half:2], tree[half + 1:2 * half:2])
        half //= 2
    out = np.full(len(starts), len(values), np.int64)
    ask = np.flatnonzero(starts < len(values))
    at = starts[ask].astype(np.int64) + size
    while len(ask):
        at //= at & -at                                       # the largest range that begins there
        found = tree[at] >= least[ask]
        node, who = at[found], ask[found]
        while (node < size).any():
            inner = node < size
            left = 2 * node[inner]
            node[inner] = left + (tree[left] < least[who[inner]])
        out[who] = node - size
        ask, at = ask[~found], at[~found] + 1
        more = (at & -at) != at                               # the last range ended
        ask, at = ask[more], at[more]
    return out


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(NEVER).to_numpy()


def _look_up(rows: pa.Table, commands: pa.Table) -> pa.Table:
    """One block's rows and commands: the hits, and who goes on to later blocks (``on_from``: this block)."""
    schema = pa.schema([("command_id", pa.int64()), ("alert_ts", pa.timestamp("us")), ("alert_order_id", pa.string()),
                        ("alert_cum_pnl", pa.decimal128(38, 6)), ("on_from", pa.int64())])
    if not rows.num_rows or not commands.num_rows:
        return schema.empty_table()
    rows = rows.take(pc.sort_indices(rows, [("ts", "ascending"), ("order_id", "ascending"), ("cum_pnl", "ascending")]))
    ts, values = _micros(rows["ts"]), rows["value"].to_numpy()
    starts = np.searchsorted(ts, _micros(commands["cmd_ts"]), "left")
    ends = _micros(commands["next_ts"])
    i = first_at_least(values, starts, commands["least"].to_numpy())
    there = i < len(values)
    hit = there & (ts[np.minimum(i, len(values) - 1)] < ends)
    on = ~there & (ts[-1] < ends)
    at = pa.array(i[hit])
    ids, blk = commands["command_id"].combine_chunks(), commands["blk"].combine_chunks()
    hits = pa.table({"command_id": ids.filter(pa.array(hit)), "alert_ts": rows["ts"].take(at).cast(pa.timestamp("us")),
                     "alert_order_id": rows["order_id"].take(at), "alert_cum_pnl": rows["cum_pnl"].take(at),
                     "on_from": pa.nulls(len(at), pa.int64())}).cast(schema)
    n = int(on.sum())
    late = pa.table({"command_id": ids.filter(pa.array(on)), "alert_ts": pa.nulls(n, pa.timestamp("us")),
                     "alert_order_id": pa.nulls(n, pa.string()), "alert_cum_pnl": pa.nulls(n, pa.decimal128(38, 6)),
                     "on_from": blk.filter(pa.array(on))}).cast(schema)
    return pa.concat_tables([hits, late])


def _in_blocks(rows: DataFrame, commands: DataFrame, bases: DataFrame) -> DataFrame:
    """Look every command up in its block ``blk``."""
    spark = rows.sparkSession
    counts = commands.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).collect()      # a row a block at most
    shares = spark.createDataFrame([(r["blk"], -(-r["n"] // COMMANDS_A_TASK)) for r in counts], "blk long, shares long")
    exact = lambda c: F.expr(f"cast({c} * {SCALE} as bigint)")
    rows = (rows.join(F.broadcast(shares), "blk").join(F.broadcast(bases), "blk")
            .select("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                    "ts", "order_id", "cum_pnl", exact("(cum_pnl - base)").alias("value")))
    least = exact(f"least(greatest(cast(threshold as decimal(38,6)) - base, -{FARTHEST}), {FARTHEST})")
    commands = (commands.join(F.broadcast(shares), "blk").join(F.broadcast(bases), "blk")
                .select("blk", F.pmod(F.xxhash64("command_id"), "shares").alias("share"), "command_id", "cmd_ts", "next_ts",
                        least.alias("least")))
    return (rows.groupBy("blk", "share").cogroup(commands.groupBy("blk", "share")).applyInArrow(_look_up, HITS))


def first_reaching(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """command_id, alert_ts, alert_order_id, alert_cum_pnl of every command that is reached.

    ``rows``: ts, order_id, cum_pnl and blk, a block number in (ts, order_id) order (written: it is read
    several times). ``commands``: command_id, threshold, cmd_ts and next_ts (null: open); a row counts
    from cmd_ts on and before next_ts."""
    spark = rows.sparkSession
    summary = rows.groupBy("blk").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                      F.max("cum_pnl").alias("top"), F.min("cum_pnl").alias("base")).collect()
    summary.sort(key=lambda r: r["blk"])                       # a row a block
    bases = spark.createDataFrame([(r["blk"], r["base"]) for r in summary], "blk long, base decimal(38,6)")
    blks = [r["blk"] for r in summary]
    lasts = np.array([r["last_ts"] for r in summary], "datetime64[us]")
    firsts = np.array([r["first_ts"] for r in summary], "datetime64[us]")
    tops = [[r["top"] for r in summary]]                       # tops[k][i]: the maximum of 2^k blocks from i on
    while len(tops[-1]) > 1 << (len(tops) - 1):
        k, t = 1 << (len(tops) - 1), tops[-1]
        tops.append([max(x, y) for x, y in zip(t, t[k:] + t[-1:] * k)])
    at = {b: i for i, b in enumerate(blks)}

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i = np.searchsorted(lasts, b["cmd_ts"].values.astype("datetime64[us]"), "left")
            b = b[i < len(blks)]
            yield b.assign(blk=np.array(blks, np.int64)[i[i < len(blks)]])

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for blk, threshold, end in zip(b["on_from"], b["threshold"], b["next_ts"]):
                i = at[blk] + 1
                for k in range(len(tops) - 1, -1, -1):
                    if i < len(blks) and tops[k][i] < threshold:
                        i += 1 << k
                open_ = i < len(blks) and (pd.isnull(end) or firsts[i] < np.datetime64(end, "us"))
                found.append(blks[i] if open_ else -1)
            b = b.assign(blk=np.array(found, np.int64))
            yield b[b["blk"] >= 0].drop(columns="on_from")

    commands = commands.select("command_id", F.col("threshold").cast("decimal(38,6)").alias("threshold"),
                               F.col("cmd_ts").cast("timestamp_ntz").alias("cmd_ts"),
                               F.col("next_ts").cast("timestamp_ntz").alias("next_ts"))
    kind = "command_id long, threshold decimal(38,6), cmd_ts timestamp_ntz, next_ts timestamp_ntz, blk long"
    first = _in_blocks(rows, commands.mapInPandas(begin, kind).checkpoint(), bases).checkpoint()
    on = first.where("on_from is not null").select("command_id", "on_from").join(commands, "command_id")
    on = on.select("command_id", "threshold", "cmd_ts", "next_ts", "on_from").mapInPandas(later, kind).checkpoint()
    second = _in_blocks(rows, on, bases)
    return first.where("on_from is null").drop("on_from").unionByName(second.drop("on_from"))
