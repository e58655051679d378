"""Distributed running aggregates and carry-forward without one-partition windows.

A window with no PARTITION BY (or one partitioned by a hot key) runs in a
single task. These helpers split the order into blocks of ``block_size``
consecutive order values, aggregate each block in parallel, take the
prefix over the (few) block summaries, and finish inside each block with a
window partitioned by block. Every window partition is bounded by the block
size whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.session import checkpoint_dir


DEFAULT_BLOCK = 1 << 20


def block_of(order_col: str, block_size: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(int(block_size))).cast("bigint")


def prefix_sum(df: DataFrame, value: str, order: list[str], out: str,
               partition: list[str] | None = None, block_col: str | None = None,
               block_size: int = DEFAULT_BLOCK, inclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` ordered by ``order`` (within ``partition``).

    ``block_col`` names an existing, order-monotone block column; otherwise
    blocks are ``order[0] div block_size`` (order[0] must be numeric).
    ``inclusive=False`` gives the sum of strictly earlier rows.
    """
    part = list(partition or [])
    blk = block_col or "_blk"
    d = df if block_col else df.withColumn(blk, block_of(order[0], block_size))
    totals = d.groupBy(*part, blk).agg(F.sum(value).alias("_blk_total"))
    wb = Window.partitionBy(*part).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, blk, F.coalesce(F.sum("_blk_total").over(wb), F.lit(0)).alias("_carry"))
    # One row per block: AQE broadcasts it from its measured shuffle size.
    # No eager size-check job here: both uses of ``d`` must stay in one plan
    # so they share one exchange (a range-partitioned ``d`` is re-sampled by
    # every separate job).
    d = d.join(totals, part + [blk], "inner")
    frame = (Window.partitionBy(*part, blk).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    d = d.withColumn(out, F.col("_carry") + F.coalesce(F.sum(value).over(frame), F.lit(0)))
    d = d.drop("_carry")
    return d if block_col else d.drop(blk)


def ordered_blocks(df: DataFrame, order: list[str], n_blocks: int | None = None,
                   block_col: str = "_blk") -> DataFrame:
    """Cut a global order into ``n_blocks`` contiguous, balanced blocks.

    ``repartitionByRange`` samples the order key, so even a day or key that
    holds a third of all rows is split over several blocks (the full order
    key, including its tiebreak, is the range key). The block id is the
    partition id, monotone in the order.

    Range bounds are sampled per job (the sampler is seeded by RDD id), so
    two jobs over the same input can cut different blocks. The blocked rows
    are therefore checkpointed once to the cluster's shared checkpoint
    folder: every consumer, and any recomputation after an executor loss,
    reads the same assignment.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(n_blocks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    b = df.repartitionByRange(n, *order).withColumn(block_col, F.spark_partition_id().cast("bigint"))
    return b.checkpoint(eager=True)


#: A monotonic id holds the partition above these bits and the place in it below.
PLACE_BITS = 33


def dense_order(df: DataFrame, keys: list[str], order: list[str], out: str, n_parts: int | None = None) -> DataFrame:
    """``out``: the row's number (from 0) within its keys by ``order``, without a window over a key.

    Rows are range-partitioned and sorted by keys and order, and written once (range
    bounds are sampled per job). A row's number is its place in the partition, less the first place of
    its keys there, plus the keys' rows in earlier partitions: counts of one row per partition and key
    in it, which are at most partitions + keys.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(n_parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    b = (df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
         .withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True))
    part = F.shiftright("_at", PLACE_BITS)
    counts = b.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    b = b.withColumn("_part", part).join(counts, [*keys, "_part"])
    return b.withColumn(out, F.col("_base") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_base")


def global_prefix_sum(df: DataFrame, value: str, order: list[str], out: str,
                      n_blocks: int | None = None, inclusive: bool = True, keep: str | None = None) -> DataFrame:
    """Running sum over a global order with no single-task window; ``keep``: the
    name under which the block column stays."""
    blk = keep or "_gblk"
    b = prefix_sum(ordered_blocks(df, order, n_blocks, blk), value, order, out, block_col=blk, inclusive=inclusive)
    return b if keep else b.drop(blk)


def previous_in_key(df: DataFrame, key: str, order: list[str], value: str, out: str, n_parts: int | None = None) -> DataFrame:
    """``lag(value)`` within ``key`` by ``order`` without a window over a whole key: lag within range blocks of
    (key, order), and for a key's first row of a block the last value in its blocks before (a window over one row
    per block and key in it)."""
    b = ordered_blocks(df, [key, *order], n_parts, "_kblk")
    w = Window.partitionBy("_kblk", key).orderBy(*order)
    last = b.groupBy(key, "_kblk").agg(F.max(F.struct(*order, value)).alias("_l"))
    last = last.select(key, "_kblk", F.lag(f"_l.{value}").over(Window.partitionBy(key).orderBy("_kblk")).alias("_before"))
    b = b.withColumn("_lag", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    b = b.alias("b").join(last.alias("l"), F.col(f"b.{key}").eqNullSafe(F.col(f"l.{key}"))
                          & (F.col("b._kblk") == F.col("l._kblk")), "left").select("b.*", "l._before")
    return b.withColumn(out, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))) \
        .drop("_kblk", "_lag", "_n", "_before")


def next_in_order(df: DataFrame, order_col: str, out: str, n_blocks: int | None = None) -> DataFrame:
    """``lead(order_col)`` over a global order without a one-task window:
    lead within range blocks, and for each block's last row the first value
    of the next non-empty block (a window over the few block rows)."""
    b = ordered_blocks(df, [order_col], n_blocks, "_nblk")
    inner = b.withColumn("_lead", F.lead(order_col).over(Window.partitionBy("_nblk").orderBy(order_col)))
    firsts = b.groupBy("_nblk").agg(F.min(order_col).alias("_first"))
    firsts = firsts.select("_nblk", F.lead("_first").over(Window.orderBy("_nblk")).alias("_next_block_first"))
    j = inner.join(firsts, "_nblk", "left")
    return j.withColumn(out, F.coalesce("_lead", "_next_block_first")).drop("_nblk", "_lead", "_next_block_first")
