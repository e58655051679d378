"""Operator 9: sharding by proportional stratified interleaving.

1. Rows are sorted by source and a seeded hash (a range partitioning, so a hot
   source spreads over many partitions) and written. A row's rank within its source is
   its place in the partition plus the source's rows in earlier partitions: a running
   sum over one row per partition and source.
2. Rows are sorted by fractional rank, (rank + 1/2) / rows of the source, which
   interleaves the sources in proportion, and written. A row's global position is its
   place plus its partition's base (a prefix sum, one row a partition).
3. Shard s takes the positions from ceil(s N / shards) on. Row counts differ by
   one at most (law ``rows``), and every source by about one row from its share.

Defined results: a null text has no bytes; null sources are a source of their own;
null doc_ids are kept; repeated rows are placed each; with fewer rows than shards some
shards are empty; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import read, stage

SHARDS, SEED, EXTRA_BYTES = 40, 11, 16
PLACE = (1 << 33) - 1             # a monotonic id holds the partition above these bits


def _sorted(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Globally sorted and written, with part and place (within the part)."""
    df = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return stage(df, name).select("*", F.shiftright("at", 33).alias("part"),
                                  F.col("at").bitwiseAND(F.lit(PLACE)).alias("place")).drop("at")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       (F.octet_length(body).cast("long") + EXTRA_BYTES).alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    rows = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    order = ("key", "doc_id", "text_crc32", "size")
    ranked = _sorted(rows, "shard-ranked", "stratum", *order)
    counts = ranked.groupBy("part", "stratum").agg(F.min("place").alias("low"), F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "stratum", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                           F.sum("n").over(whole).alias("total"))
    fraction = (F.col("base") + F.col("place") - F.col("low") + 0.5) / F.col("total")
    mixed = ranked.join(counts, ["part", "stratum"]).withColumn("fraction", fraction)
    mixed = _sorted(mixed.select("doc_id", "source", "size", "text_crc32", "key", "fraction"), "shard-mixed",
                    "fraction", *order)
    sizes = {r["part"]: r["n"] for r in mixed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, bases = 0, []
    for p in sorted(sizes):                                     # one row a partition
        bases.append((p, total))
        total += sizes[p]
    bases = docs.sparkSession.createDataFrame(bases, "part long, base long")
    placed = (mixed.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("place"))
              .withColumn("shard", F.expr(f"cast(at * {shards} div {max(total, 1)} as int)")))
    start = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("at") - start).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
