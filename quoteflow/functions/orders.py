"""Column expressions for orders: venue symbols, signed amounts, fill parsing
and fill classification (X6-X10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QTY = T.DecimalType(18, 8)

# Order statuses.
FULLY_FILLED = "FullyFilled"
PARTIALLY = "PartiallyFulfilled"
NOT_FILLED = "NotFilled"
PENDING = "Pending"

#: A report that gives no filled quantity: unreadable, an error reply, or a venue not supported.
UNREADABLE = "Unreadable"

_KRAKEN_STATUS = T.StructType([
    T.StructField("result", T.MapType(T.StringType(), T.StructType([T.StructField("vol_exec", T.StringType())]))),
])


def venue_symbol(exchange: Column, pair: Column) -> Column:
    """Bitfinex "t" + pair, Kraken "XX" + pair, Bitstamp lower-case pair,
    dash removed; null for an unsupported venue."""
    bare = F.regexp_replace(pair, "-", "")
    return (F.when(exchange == "Bitfinex", F.concat(F.lit("t"), bare))
            .when(exchange == "Kraken", F.concat(F.lit("XX"), bare))
            .when(exchange == "Bitstamp", F.lower(bare)))


def signed_amount(exchange: Column, order_type: Column, quantity: Column) -> Column:
    """Bitfinex takes sell quantities as negative; the others take them plain."""
    return F.when((exchange == "Bitfinex") & (order_type == "sell"), -quantity).otherwise(quantity)


def submitted_order_id(exchange: Column, payload: Column) -> Column:
    """Order id in a submit response: ``[4][0][0]``, ``result.txid[0]``, ``id``."""
    return (F.when(exchange == "Bitfinex", F.get_json_object(payload, "$[4][0][0]"))
            .when(exchange == "Kraken", F.get_json_object(payload, "$.result.txid[0]"))
            .when(exchange == "Bitstamp", F.get_json_object(payload, "$.id")))


def filled_quantity(exchange: Column, payload: Column, order_id: Column, quantity: Column) -> Column:
    """Filled quantity from a status response:
    Bitfinex abs(``[0][4]``); Kraken ``result[order_id].vol_exec`` (dynamic
    key); Bitstamp quantity - ``amount_remaining``. Unparseable -> null."""
    bitfinex = F.abs(F.get_json_object(payload, "$[0][4]").try_cast(QTY))
    kraken_doc = F.from_json(payload, _KRAKEN_STATUS)
    kraken = F.try_element_at(kraken_doc["result"], order_id)["vol_exec"]
    bitstamp_rem = F.get_json_object(payload, "$.amount_remaining")
    return (F.when(exchange == "Bitfinex", bitfinex.cast(QTY))
            .when(exchange == "Kraken", kraken.try_cast(QTY))
            .when(exchange == "Bitstamp", (quantity - bitstamp_rem.try_cast(QTY)).cast(QTY)))


def fill_status(filled: Column, quantity: Column) -> Column:
    """Filled >= quantity -> FullyFilled; 0 -> NotFilled; no quantity
    known -> Unreadable; else partial."""
    return (F.when(filled.isNull(), F.lit(UNREADABLE))
            .when(filled >= quantity, F.lit(FULLY_FILLED))
            .when(filled == 0, F.lit(NOT_FILLED))
            .otherwise(F.lit(PARTIALLY)))
