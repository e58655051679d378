"""Date parameters from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the reference's reply to unparseable dates.
MSG_INVALID_DATES = "Invalid dates provided"


def parse_timestamp(text: Column) -> Column:
    """Lenient parse (null when the text is not a date/time)."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
                      F.try_to_timestamp(text, F.lit("M/d/yyyy")))


def period_requests(requests: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Parse (start, end) text pairs; both must parse, else the reference's error."""
    s, e = parse_timestamp(F.col(start)), parse_timestamp(F.col(end))
    return requests.withColumn("start_ts", s).withColumn("end_ts", e).withColumn(
        "error", F.when(F.col("start_ts").isNull() | F.col("end_ts").isNull(), F.lit(MSG_INVALID_DATES)))
