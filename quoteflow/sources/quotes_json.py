"""Quote JSON sources (S1-S3) with explicit schemas.

* S1: a landed quote file holding one JSON array of quote objects, whole by one
  task (``read_quote_file``, ``multiLine``) or by byte ranges (``read_quote_array``);
* S2: quotes parsed from a JSON string column, array position kept as the
  arrival order inside the string;
* S3: live frames: each frame is a JSON array whose *first* element's ``ev``
  selects the frame type; ``XQ`` (and ``XT`` when enabled) frames decode every
  element as a quote, ``status`` and unknown types are dropped. A malformed
  frame, or one with an element whose field has a value of another type, is
  dropped whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow import schemas
from quoteflow.operators.running import dense_order, prefix_sum

QUOTE_EVENTS = ("XQ",)
QUOTE_AND_TRADE_EVENTS = ("XQ", "XT")

_FRAME_HEAD = T.ArrayType(T.StructType([T.StructField("ev", T.StringType())]))


def read_quote_file(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """One JSON array per file (``multiLine``), explicit schema."""
    schema = schemas.LIVE_QUOTE if live else schemas.QUOTE
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _opened(parts: Column, outside: int) -> Column:
    """Braces opened in every second part between quotes."""
    each = F.transform(parts, lambda p, i: F.when(i % 2 == outside, F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON array files as text: file, block and at (their order in the file), element.

    A file is read as text records that end with ``}``, so Spark cuts it by byte ranges like any text
    file. Where every record holds one whole object, it is an element. Otherwise (objects within objects, braces in
    texts) running sums say where elements end: quotes passed give whether a record begins inside a
    text, which of its braces count follows from that, and an element ends with the brace that brings the depth
    back to 0. The sums run per byte range over totals of ranges, so no task sees a whole file; only records of
    one element are put together."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(plain, '"')
    raw = raw.withColumn("quotes", F.size(parts) - 1).withColumn("outside", _opened(parts, 0)).withColumn("inside", _opened(parts, 1))
    rest = (F.col("quotes") == 0) & (F.col("outside") == 0)                    # what follows the last element
    odd = raw.where(~rest & ((F.col("quotes") % 2 != 0) | (F.col("outside") != 1))).limit(1).count()
    whole = lambda c: F.concat(F.expr(f"substring({c}, instr({c}, '{{'))"), F.lit("}"))
    if not odd:
        return raw.where(~rest).select("file", "block", "at", whole("value").alias("element"))
    total = lambda df, v, out: prefix_sum(df, v, ["at"], out, partition=["file"], block_col="block")
    r = total(raw, "quotes", "before")
    ends_outside = (F.col("before") + F.col("quotes")) % 2 == 0
    r = r.withColumn("closes", F.when(ends_outside, 1).otherwise(0))
    r = r.withColumn("change", F.when(F.col("before") % 2 == 0, F.col("outside")).otherwise(F.col("inside")) - F.col("closes"))
    r = total(r, "change", "depth")
    r = r.withColumn("ends", F.when((F.col("closes") == 1) & (F.col("depth") + F.col("change") == 0), 1).otherwise(0))
    r = total(r, "ends", "number")
    g = r.groupBy("file", "number").agg(
        F.min(F.struct("block", "at")).alias("o"), F.max("ends").alias("ended"),
        F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("records"))
    text = F.array_join(F.transform("records", lambda x: x["value"]), "}")
    return g.where("ended = 1").withColumn("text", text).select("file", "o.block", "o.at", whole("text").alias("element"))


def read_quote_array(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """S1 for large files: what ``read_quote_file`` reads, by as many tasks as the files have byte ranges, with ``seq``, a
    dense arrival number by file and place."""
    schema = schemas.LIVE_QUOTE if live else schemas.QUOTE
    q = array_elements(spark, path).select("file", "block", "at", F.from_json("element", schema).alias("q"))
    return dense_order(q.select("file", "block", "at", "q.*"), [], ["file", "block", "at"], "seq").drop("file", "block", "at")


#: The number of the first landed file.
FIRST_FILE = 10**13


def land_arrays(quotes: DataFrame, path: str, rows_a_file: int) -> None:
    """Land quotes as JSON array files of ``rows_a_file`` consecutive ``seq`` each, the shape of the historical feed.

    A task sorts and writes the quotes of one file: there are more ranges than files, so every file number ends a
    range. Numbers have one length, so that paths are in the order of files."""
    fields = [f.name for f in schemas.QUOTE.fields if f.name in quotes.columns]
    number = F.floor(F.col("seq") / rows_a_file).cast("bigint")
    first, n = quotes.agg(F.min(number), F.count_distinct(number)).first()
    q = quotes.withColumn("file", number + F.lit(FIRST_FILE - (first or 0)))
    ends = q.groupBy("file").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    q = q.join(F.broadcast(ends), "file")                       # a row a file
    line = F.concat(F.when(F.col("seq") == F.col("lo"), "[").otherwise(""), F.to_json(F.struct(*fields)),
                    F.when(F.col("seq") == F.col("hi"), "]").otherwise(","))
    (q.repartitionByRange(2 * n + 1, "file").sortWithinPartitions("file", "seq").select("file", line.alias("value"))
     .write.mode("overwrite").partitionBy("file").text(path))


def parse_quotes(df: DataFrame, col: str, live: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Explode a JSON array string into quote rows with its position."""
    schema = T.ArrayType(schemas.LIVE_QUOTE if live else schemas.QUOTE)
    keep = keep or []
    arr = F.from_json(F.col(col), schema)
    e = df.select(*keep, F.posexplode_outer(arr).alias("pos", "q"))
    return e.where(F.col("q").isNotNull()).select(*keep, "pos", "q.*")


def frame_type(col: Column) -> Column:
    """The ``ev`` of a frame's first element; null when the frame is not a
    non-empty JSON array (``from_json`` alone would wrap a bare object)."""
    is_array = F.ltrim(col).startswith("[")
    return F.when(is_array, F.try_element_at(F.from_json(col, _FRAME_HEAD), F.lit(1))["ev"])


def well_typed(col: Column) -> Column:
    """Whether every field present in a frame's elements has its type."""
    fields = [f.name for f in schemas.LIVE_QUOTE.fields]
    as_text = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    broken = F.zip_with(F.from_json(col, as_text), F.from_json(col, T.ArrayType(schemas.LIVE_QUOTE)),
                        lambda r, t: reduce(or_, [r[f].isNotNull() & t[f].isNull() for f in fields]))
    return ~F.exists(broken, lambda b: b)


#: Prices and sizes: an absent one decodes to 0.
AMOUNTS = ("lp", "ls", "bp", "bs", "ap", "as")


def frame_quotes(frames: DataFrame, col: str = "value", order_col: str = "frame_seq",
                 events=QUOTE_EVENTS) -> DataFrame:
    """S3: keep quote frames by their first element's ``ev`` and explode them, with
    ``order_col`` and the position ``pos`` in the frame; a stream or a table."""
    f = frames.where(frame_type(F.col(col)).isin(*events) & well_typed(F.col(col)))
    q = parse_quotes(f, col, live=True, keep=[order_col])
    return q.withColumns({c: F.coalesce(c, F.lit(0).cast(q.schema[c].dataType)) for c in AMOUNTS})


def live_frames(frames: DataFrame, col: str = "value", order_col: str = "frame_seq",
                events=QUOTE_EVENTS) -> DataFrame:
    """S3 in batch: ``frame_quotes`` with ``seq``, a dense arrival number by frame and position. Frames may have
    any number of elements."""
    q = frame_quotes(frames, col, order_col, events)
    return dense_order(q, [], [order_col, "pos"], "seq").drop("pos")


def frames_from_ticks(ticks: DataFrame, frame_size: int = 16) -> DataFrame:
    """Land live ticks as JSON frames of ``frame_size`` consecutive quotes (a
    bounded per-frame collect), the shape the feed delivers."""
    fields = [f.name for f in schemas.LIVE_QUOTE.fields]
    g = ticks.groupBy(F.floor(F.col("seq") / frame_size).cast("bigint").alias("frame_seq")).agg(
        F.sort_array(F.collect_list(F.struct("seq", F.struct(*fields).alias("q")))).alias("items"))
    return g.select("frame_seq", F.to_json(F.transform("items", lambda i: i["q"])).alias("value"))
