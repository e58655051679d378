"""Hot keys: one pair carrying most ticks/trades gives the same results when
the order is cut into many small blocks (the scale path) as with one block."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quoteflow.operators import history, opportunities as O, running
from quoteflow.plans import catalog
from quoteflow.sources import adapters


def hot_ticks(spark):
    # ~2/3 of all ticks on pair P00-USD
    t = adapters.live_quotes(spark, SF_SMALL, n_pairs=3)
    return t.withColumn("pair", F.when(F.col("pair") == "P02-USD", "P00-USD").otherwise(F.col("pair")))


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_hot_pair_grid_and_budget_with_small_blocks(spark):
    t = hot_ticks(spark)
    cols = ["pair", "seq", "x", "q_seq", "bp", "ap"]
    small = O.latest_quote_grid(t, block_size=16)
    assert rows(small, cols) == rows(O.latest_quote_grid(t), cols)
    p = catalog.LIVE_PARAMS
    ecols = ["pair", "seq", "buy_x", "sell_x", "quantity", "prior_value"]
    a = O.executed_opportunities(O.best_opportunity(small, p), p, block_size=2)
    b = O.executed_opportunities(O.best_opportunity(O.latest_quote_grid(t), p), p)
    assert rows(a, ecols) == rows(b, ecols) and len(rows(a, ecols)) > 0


def test_hot_pair_history_counts_are_partition_independent(spark):
    q = adapters.quotes(spark, SF_SMALL, n_pairs=2)
    q = q.withColumn("pair", F.lit("HOT"))
    a = history.opportunities_per_pair(q.repartition(1), catalog.HIST_BUCKET_MS).collect()
    b = history.opportunities_per_pair(q.repartition(13, "seq"), catalog.HIST_BUCKET_MS).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and len(a) == 1


def test_prefix_sum_blocks(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("seq"), (F.col("id") % 7).cast("decimal(38,10)").alias("v"))
    a = running.prefix_sum(df, "v", ["seq"], "run", block_size=37).orderBy("seq").collect()
    b = running.global_prefix_sum(df, "v", ["seq"], "run", n_blocks=9, inclusive=False).orderBy("seq").collect()
    total, want = 0, []
    for r in a:
        want.append(total)
        total += r.v
    assert [r.run for r in a] == want == [r.run for r in b]


def test_next_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 3).alias("ts"))
    got = {r.ts: r.nxt for r in running.next_in_order(df, "ts", "nxt", n_blocks=7).collect()}
    assert all(got[k] == (k + 3 if k < 2997 else None) for k in got)
