"""Historical arbitrage scan (C1) and its report.

Semantics kept from the reference:
* quotes are grouped into buckets ``t div bucket_ms`` (truncating division);
* within a (bucket, pair) group only groups with more than one *quote* count
  (not more than one exchange);
* each exchange is represented by its best-bid quote, the first-arrived one
  on ties, and that quote also supplies the exchange's ask;
* a group is an opportunity when some representatives i, j (i = j allowed)
  have ``bid_i - ask_j > 0.01`` (strict). That exists-pair test equals
  ``max(bid) - min(ask) > 0.01`` over the representatives, so no self-join
  is needed;
* opportunities are summed per pair and zero-count pairs are dropped.

Plan shape: partial+final hash aggregate on (bucket, pair, x), a second one
on (bucket, pair) over the already-reduced rows, a third on pair. Every
shuffle carries pre-aggregated rows, so a pair holding a third of all
quotes costs one combined row per task and key, not its raw quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the historical spread must exceed 0.01 (strictly).
HISTORY_MIN_SPREAD = "0.01"


def with_bucket(quotes: DataFrame, bucket_ms: int = 5) -> DataFrame:
    """A1: time bucket of each quote."""
    return quotes.withColumn("bucket", F.expr(f"t div {int(bucket_ms)}"))


def best_quotes(quotes: DataFrame, bucket_ms: int = 5) -> DataFrame:
    """A2: per (bucket, pair, exchange) the best-bid quote, first arrival on ties.

    ``max(struct(bp, -seq, ...))`` is an ordinary commutative aggregate, so it
    runs partial (map-side) and final; ``max_by`` would not break ties stably.
    """
    q = with_bucket(quotes, bucket_ms)
    agg = q.groupBy("bucket", "pair", "x").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.min("seq").alias("first_seq"),
        F.max(F.struct(F.col("bp"), (-F.col("seq")).alias("neg_seq"), F.col("ap"))).alias("best"))
    return agg.select(
        "bucket", "pair", "x", "n_quotes", "first_seq",
        F.col("best.bp").alias("bp"), F.col("best.ap").alias("ap"),
        (-F.col("best.neg_seq")).alias("best_seq"))


def bucket_flags(quotes: DataFrame, bucket_ms: int = 5) -> DataFrame:
    """J1 + A3 + F1 per (bucket, pair): quote count, arrival keys and the 0/1 flag.

    Rows are kept for every (bucket, pair), also those failing F1, because the
    bucket's first arrival is taken over all its rows.
    """
    reps = best_quotes(quotes, bucket_ms)
    g = reps.groupBy("bucket", "pair").agg(
        F.sum("n_quotes").alias("n_quotes"),
        F.min("first_seq").alias("pair_first_seq"),
        F.max("bp").alias("max_bid"),
        F.min("ap").alias("min_ask"))
    # A bucket holds at most one row per pair here, so this window is small
    # whatever the raw skew.
    g = g.withColumn("bucket_first_seq", F.min("pair_first_seq").over(Window.partitionBy("bucket")))
    return g.withColumn(
        "flag", (F.col("max_bid") - F.col("min_ask") > F.lit(HISTORY_MIN_SPREAD).cast("decimal(3,2)")).cast("int"))


def opportunities_per_pair(quotes: DataFrame, bucket_ms: int = 5, keep_zero: bool = False) -> DataFrame:
    """A4 + F2: opportunity count per pair, with the pair's first-appearance key
    (the reference's list order): the earliest (bucket first arrival, pair first
    arrival in that bucket) over buckets where the pair passes F1."""
    f = bucket_flags(quotes, bucket_ms).where(F.col("n_quotes") > 1)
    out = f.groupBy("pair").agg(
        F.sum("flag").cast("bigint").alias("opportunities"),
        F.min(F.struct("bucket_first_seq", "pair_first_seq")).alias("first_key"))
    out = out.select("pair", "opportunities",
                     F.col("first_key.bucket_first_seq").alias("order_bucket_seq"),
                     F.col("first_key.pair_first_seq").alias("order_pair_seq"))
    return out if keep_zero else out.where(F.col("opportunities") != 0)


def report(counts: DataFrame) -> DataFrame:
    """The reference's text line "PAIR, n opportunities"."""
    return counts.select(
        "pair", "opportunities",
        F.format_string("%s, %d opportunities", F.col("pair"), F.col("opportunities")).alias("line"))
