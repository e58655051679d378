"""Cross-traded pairs (C2): parse the venues' listing payloads, concatenate,
keep pairs listed more than once.

Payload rules kept from the reference:
* Bitfinex: ``array<array<string>>`` whose outer array has exactly one element;
  ':' becomes '/' before splitting, so a bare ``ABCDEF`` symbol is dropped;
* Bitstamp: array of ``{name}``;
* Kraken: ``{error, result}``, used only when ``error`` is an empty array; the
  symbols are the ``wsname`` of the map values;
* a symbol is kept when it splits into exactly two 3-character parts;
* cross-traded = the same (c1, c2) occurring more than once in the
  concatenation (the reference does no per-venue distinct; ``strict=True``
  requires two distinct venues instead).
Parsing is ``from_json`` + ``explode`` per payload row: fully parallel, no
driver round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow import schemas
from quoteflow.functions.pairs import pair_label, split_symbol

LISTING_COLUMNS = ["source", "fetch_id", "currency1", "currency2"]


def _split(df: DataFrame, symbol_col: str) -> DataFrame:
    c1, c2, ok = split_symbol(F.col(symbol_col))
    return df.where(ok).select("source", "fetch_id", c1.alias("currency1"), c2.alias("currency2"))


def parse_bitfinex(payloads: DataFrame) -> DataFrame:
    """X1."""
    p = payloads.where(F.col("source") == "bitfinex").select(
        "source", "fetch_id", F.from_json("payload", schemas.BITFINEX_LISTING).alias("outer"))
    p = p.where(F.coalesce(F.size("outer"), F.lit(-1)) == 1)
    e = p.select("source", "fetch_id",
                 F.explode(F.try_element_at("outer", F.lit(1))).alias("symbol"))
    e = e.withColumn("symbol", F.replace(F.col("symbol"), F.lit(":"), F.lit("/")))
    return _split(e, "symbol")


def parse_bitstamp(payloads: DataFrame) -> DataFrame:
    """X2."""
    p = payloads.where(F.col("source") == "bitstamp").select(
        "source", "fetch_id", F.from_json("payload", schemas.BITSTAMP_LISTING).alias("items"))
    e = p.select("source", "fetch_id", F.explode("items").alias("item"))
    return _split(e.select("source", "fetch_id", F.col("item.name").alias("symbol")), "symbol")


def parse_kraken(payloads: DataFrame) -> DataFrame:
    """X3."""
    p = payloads.where(F.col("source") == "kraken").select(
        "source", "fetch_id", F.from_json("payload", schemas.KRAKEN_LISTING).alias("doc"))
    p = p.where(F.coalesce(F.size("doc.error"), F.lit(-1)) == 0)
    e = p.select("source", "fetch_id", F.explode(F.map_values("doc.result")).alias("v"))
    return _split(e.select("source", "fetch_id", F.col("v.wsname").alias("symbol")), "symbol")


def venue_symbols(source, payload):
    """X1-X3 as one expression: the raw symbols a payload lists, by venue rule
    (empty when the payload is rejected). Bitfinex ':' is already '/'."""
    outer = F.from_json(payload, schemas.BITFINEX_LISTING)
    bitfinex = F.when(F.coalesce(F.size(outer), F.lit(-1)) == 1,
                      F.transform(F.try_element_at(outer, F.lit(1)),
                                  lambda s: F.replace(s, F.lit(":"), F.lit("/"))))
    bitstamp = F.transform(F.from_json(payload, schemas.BITSTAMP_LISTING), lambda i: i["name"])
    doc = F.from_json(payload, schemas.KRAKEN_LISTING)
    kraken = F.when(F.coalesce(F.size(doc["error"]), F.lit(-1)) == 0,
                    F.transform(F.map_values(doc["result"]), lambda v: v["wsname"]))
    return (F.when(source == "bitfinex", bitfinex).when(source == "bitstamp", bitstamp)
            .when(source == "kraken", kraken))


def all_listings(payloads: DataFrame) -> DataFrame:
    """Concatenation of every venue's parsed pairs, duplicates kept. One
    pass over the payloads (a CASE picks the venue's parser per row), one
    explode, one split; the per-venue parsers above are the same rules."""
    e = payloads.select("source", "fetch_id",
                        F.explode(venue_symbols(F.col("source"), F.col("payload"))).alias("symbol"))
    return _split(e, "symbol")


def cross_traded(listings: DataFrame, strict: bool = False) -> DataFrame:
    """A5 + X4: pairs occurring more than once (or on two venues if strict)
    within one fetch; each pair once, with its largest counts in a fetch."""
    g = listings.groupBy("fetch_id", "currency1", "currency2").agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.countDistinct("source").alias("n_exchanges"))
    cond = (F.col("n_exchanges") > 1) if strict else (F.col("n_listings") > 1)
    return g.where(cond).groupBy("currency1", "currency2").agg(
        pair_label(F.col("currency1"), F.col("currency2")).alias("pair"),
        F.max("n_listings").alias("n_listings"), F.max("n_exchanges").alias("n_exchanges"))


def complete_sources(payloads: DataFrame, required=("bitfinex", "bitstamp", "kraken")) -> DataFrame:
    """Per fetch, whether every venue's payload landed (the reference fails
    the whole identification when one fetch fails)."""
    g = payloads.where(F.col("payload").isNotNull()).groupBy("fetch_id").agg(
        F.collect_set("source").alias("sources"))
    need = F.array(*[F.lit(s) for s in required])
    return g.select("fetch_id", (F.size(F.array_except(need, F.col("sources"))) == 0).alias("complete"))


def store_cross_traded(cross: DataFrame, path: str) -> None:
    """Append the identified pairs (a re-run appends duplicates, as the
    reference's inserts do)."""
    cross.select("currency1", "currency2", "pair").write.mode("append").parquet(path)


def stored_pairs(spark, path: str) -> DataFrame:
    """Every stored pair label (duplicates included)."""
    return spark.read.parquet(path).select("pair")


def identify_cross_traded(payloads: DataFrame, strict: bool = False) -> DataFrame:
    """C2 end to end: only fetches where every venue's payload landed are
    used (the reference fails the whole identification when one fetch
    fails), then parse, concatenate and count."""
    ok = complete_sources(payloads).where("complete").select("fetch_id")
    return cross_traded(all_listings(payloads.join(ok, "fetch_id", "left_semi")), strict)
