"""Pair selection (C3): historical pairs that are also cross-traded, first N
in the historical list's own order (first appearance, not by count)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.plans.joins import semi_join_small


def pairs_to_track(hist_counts: DataFrame, cross_pairs: DataFrame, n: int) -> DataFrame:
    """J3 + L1: left-semi join on the pair label, keep left order, take N.

    ``orderBy(...).limit(n)`` plans as a top-k (TakeOrderedAndProject): each
    task keeps its own N best and only those reach the final merge. The
    right side is a distinct pair list, broadcast only behind a size check.
    """
    kept = semi_join_small(hist_counts, cross_pairs.select("pair"), "pair")
    top = kept.orderBy("order_bucket_seq", "order_pair_seq").limit(int(n))
    w = Window.orderBy("order_bucket_seq", "order_pair_seq")  # at most n rows here
    return top.select(F.row_number().over(w).alias("rank"), "pair", "opportunities")
