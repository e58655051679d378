"""Entry states of a sequence of maps by tree reduction.

A key's items (numbered from 0) are maps of a state. ``entry_states`` composes runs of ``fan`` maps,
then runs of ``fan`` compositions, up to at most ``fan`` a key, and walks back down: an item's entry
state is its node's, moved through the items before it in the node. A task holds
``fan`` maps of one key; no task sees all items of a key. Maps and states are bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.session import checkpoint_dir


def entry_states(maps: DataFrame, compose: Callable[[bytes, bytes], bytes], step: Callable[[bytes, bytes], bytes],
                 start: bytes, fan: int) -> DataFrame:
    """(pair, item, state) from (pair, item, map): the state before each item."""
    checkpoint_dir(maps.sparkSession)
    maps = maps.select("pair", "item", "map")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "item": [int(pdf["item"].iloc[0]) // fan],
                             "map": [reduce(compose, pdf["map"])]})

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        states, state = [], pdf["state"].iloc[0]
        for m in pdf["map"]:
            states.append(state)
            state = step(m, state)
        return pd.DataFrame({"pair": pdf["pair"], "item": pdf["item"], "state": states})

    levels = [maps.checkpoint()]
    last = levels[0].agg(F.max("item")).first()[0] or 0
    while last >= fan:
        levels.append(levels[-1].groupBy("pair", F.expr(f"item div {fan}").alias("node"))
                      .applyInPandas(joined, maps.schema).checkpoint())
        last //= fan
    states = None
    for level in reversed(levels):
        node = level.withColumn("node", F.expr(f"item div {fan}"))
        if states is None:
            node = node.withColumn("state", F.lit(start))
        else:
            node = node.join(states.select("pair", F.col("item").alias("node"), "state"), ["pair", "node"])
        states = node.groupBy("pair", "node").applyInPandas(walked, "pair string, item long, state binary").checkpoint()
    return states
