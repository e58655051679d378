"""Column expressions on currency pairs and exchange ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange id -> venue name; unknown ids print as "Exchange<id>".
EXCHANGE_NAMES = [(6, "Bitstamp"), (23, "Kraken"), (2, "Bitfinex")]


def split_symbol(symbol: Column) -> tuple[Column, Column, Column]:
    """split on '/' (empty parts kept); valid when exactly two parts of
    exactly three characters each. Returns (currency1, currency2, is_valid)."""
    parts = F.split(symbol, "/", -1)
    c1, c2 = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    valid = (F.size(parts) == 2) & (F.length(c1) == 3) & (F.length(c2) == 3)
    return c1, c2, F.coalesce(valid, F.lit(False))


def pair_label(c1: Column, c2: Column) -> Column:
    """X4: "C1-C2"."""
    return F.concat_ws("-", c1, c2)


def exchange_name(x: Column) -> Column:
    """Exchange id to name with the "Exchange<id>" default.

    The dimension is three fixed rows, so it is a literal CASE inside the
    generated code rather than a join."""
    (first_id, first_name), *rest = EXCHANGE_NAMES
    expr = F.when(x == first_id, F.lit(first_name))
    for ex_id, name in rest:
        expr = expr.when(x == ex_id, F.lit(name))
    return expr.otherwise(F.concat(F.lit("Exchange"), x.cast("string")))


def opportunity_key(pair: Column, buy_x: Column, sell_x: Column) -> Column:
    """X11: "pair:buy->sell" once-only key."""
    return F.concat(pair, F.lit(":"), buy_x.cast("string"), F.lit("->"), sell_x.cast("string"))
