"""Hand cases for the historical scan (semantics Q1-Q4 of the survey)."""

from decimal import Decimal

from pyspark.sql import functions as F

from quoteflow.operators import history, selection


def quotes(spark, rows):
    """rows: (seq, pair, x, bp, ap, t)"""
    df = spark.createDataFrame(rows, "seq long, pair string, x int, bp string, ap string, t long")
    return df.select("seq", "pair", "x", F.col("bp").cast("decimal(18,8)").alias("bp"),
                     F.col("ap").cast("decimal(18,8)").alias("ap"), "t")


def counts(df, bucket_ms=5):
    return {r.pair: r.opportunities for r in history.opportunities_per_pair(df, bucket_ms).collect()}


def test_two_quotes_of_one_exchange_pass_and_self_pair_counts(spark):
    # Q1 + Q2: one exchange, two quotes; its best-bid quote is crossed.
    df = quotes(spark, [(1, "A", 2, "10", "9.5", 100), (2, "A", 2, "9", "12", 101)])
    assert counts(df) == {"A": 1}


def test_single_quote_group_is_dropped(spark):
    df = quotes(spark, [(1, "A", 2, "10", "1", 100)])
    assert counts(df) == {}


def test_representative_ask_comes_from_best_bid_quote(spark):
    # Q3: exchange 2's low ask (5) belongs to a lower-bid quote and is not used.
    df = quotes(spark, [(1, "A", 2, "10", "10.5", 100), (2, "A", 2, "9", "5", 101),
                        (3, "A", 6, "10", "10.5", 102)])
    assert counts(df) == {}


def test_best_bid_tie_keeps_first_arrival(spark):
    df = quotes(spark, [(1, "A", 2, "10", "10.5", 100), (2, "A", 2, "10", "5", 101),
                        (3, "A", 6, "10", "20", 102)])
    best = history.best_quotes(df, 5).where("x = 2").collect()[0]
    assert best.best_seq == 1 and best.ap == Decimal("10.5")
    assert counts(df) == {}


def test_spread_must_exceed_one_cent_strictly(spark):
    df = quotes(spark, [(1, "A", 2, "10.01", "11", 100), (2, "A", 6, "9", "10", 101)])
    assert counts(df) == {}
    df = quotes(spark, [(1, "A", 2, "10.02", "11", 100), (2, "A", 6, "9", "10", 101)])
    assert counts(df) == {"A": 1}


def test_buckets_truncate(spark):
    # Q4: t=4 and t=5 fall in different 5 ms buckets, so neither group has two quotes.
    df = quotes(spark, [(1, "A", 2, "12", "10", 4), (2, "A", 6, "12", "10", 5)])
    assert counts(df) == {}
    df = quotes(spark, [(1, "A", 2, "12", "10", 5), (2, "A", 6, "12", "10", 9)])
    assert counts(df) == {"A": 1}


def test_opportunities_sum_over_buckets_and_report_text(spark):
    df = quotes(spark, [(1, "A", 2, "12", "10", 0), (2, "A", 6, "12", "10", 1),
                        (3, "A", 2, "12", "10", 10), (4, "A", 6, "12", "10", 11)])
    rep = history.report(history.opportunities_per_pair(df, 5)).collect()
    assert [(r.pair, r.opportunities, r.line) for r in rep] == [("A", 2, "A, 2 opportunities")]


def test_pairs_to_track_keep_first_appearance_order(spark):
    # B appears first (bucket 0), A passes F1 first only in bucket 2; C is not cross-traded.
    df = quotes(spark, [(1, "B", 2, "12", "10", 0), (2, "A", 2, "12", "10", 1), (3, "B", 6, "12", "10", 2),
                        (4, "C", 2, "12", "10", 3), (5, "C", 6, "12", "10", 4),
                        (6, "A", 2, "12", "10", 10), (7, "A", 6, "12", "10", 11),
                        (8, "A", 2, "12", "10", 20), (9, "A", 6, "12", "10", 21)])
    c = history.opportunities_per_pair(df, 5)
    cross = spark.createDataFrame([("A",), ("B",)], "pair string")
    got = [(r.rank, r.pair) for r in selection.pairs_to_track(c, cross, 5).collect()]
    assert got == [(1, "B"), (2, "A")]
    got = [(r.rank, r.pair) for r in selection.pairs_to_track(c, cross, 1).collect()]
    assert got == [(1, "B")]
