"""JSON quote sources (S1-S3) and X14."""

import json
import os
import tempfile
import time
from decimal import Decimal

from quoteflow.functions import dates
from quoteflow.operators import history
from quoteflow.sources import quotes_json


def quote(pair, bid, ask, t, x):
    return {"ev": "XQ", "pair": pair, "lp": 0, "ls": 0, "bp": bid, "bs": 4.5, "ap": ask, "as": 3.25, "t": t, "x": x,
            "r": t + 40}


T0 = 1700000000000
# Two venues in one bucket, one full record, two pairs of one quote each.
GROUPING = json.dumps([quote("LTC-EUR", 71.5, 71.2, T0 + 1, 6), quote("LTC-EUR", 71.4, 71.3, T0 + 3, 2)])
ONE = json.dumps([quote("DOT-EUR", 6.25, 6.5, T0 + 7, 2)])
TWO_PAIRS = json.dumps([quote("DOT-EUR", 6.25, 6.5, T0 + 1, 2), quote("XRP-EUR", 0.5, 0.625, T0 + 2, 6)])


def parsed(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    return quotes_json.parse_quotes(df, "value").withColumnRenamed("pos", "seq")


def test_parse_all_fields(spark):
    r = parsed(spark, ONE).collect()
    assert len(r) == 1
    q = r[0]
    assert (q.ev, q.pair, q.lp, q.ls, q.bp, q.bs, q.ap, q["as"], q.t, q.x, q.r) == (
        "XQ", "DOT-EUR", Decimal(0), Decimal(0), Decimal("6.25"), Decimal("4.5"), Decimal("6.5"), Decimal("3.25"),
        T0 + 7, 2, T0 + 47)


def test_grouping_case_from_file(spark):
    d = tempfile.mkdtemp(prefix="qf-json-")
    with open(os.path.join(d, "quotes.json"), "w") as f:
        f.write(GROUPING)
    q = quotes_json.read_quote_file(spark, os.path.join(d, "quotes.json"))
    from pyspark.sql import functions as F
    q = q.withColumn("seq", F.monotonically_increasing_id())
    reps = history.best_quotes(q, 5).collect()
    assert sorted((r.pair, r.x) for r in reps) == [("LTC-EUR", 2), ("LTC-EUR", 6)]
    # 71.5 - 71.2 > 0.01 across the two exchanges
    assert [(r.pair, r.opportunities) for r in history.opportunities_per_pair(q, 5).collect()] == [("LTC-EUR", 1)]


def test_two_pairs_one_quote_each_are_dropped_by_the_product_rule(spark):
    q = parsed(spark, TWO_PAIRS)
    assert sorted(r.pair for r in history.best_quotes(q, 5).collect()) == ["DOT-EUR", "XRP-EUR"]
    assert history.opportunities_per_pair(q, 5).count() == 0


def test_live_frames_select_by_first_element(spark):
    frames = spark.createDataFrame([
        (1, '[{"ev":"status","status":"connected","message":"Connected Successfully"}]'),
        (2, ONE),
        (3, ONE.replace('"XQ"', '"XT"')),
        (4, '[{"ev":"XQ","pair":"BTC'),                 # truncated frame (4096-byte buffer)
        (5, '[]'),
        (7, json.dumps([quote("DOT-EUR", 6.25, 6.5, T0, 2), quote("DOT-EUR", "high", 6.5, T0, 6)])),   # a text price
        (6, '{"ev":"XQ"}')], "frame_seq long, value string")
    assert [r.frame_seq for r in quotes_json.live_frames(frames).collect()] == [2]
    both = quotes_json.live_frames(frames, events=quotes_json.QUOTE_AND_TRADE_EVENTS)
    assert sorted(r.frame_seq for r in both.collect()) == [2, 3]
    assert sorted((r.frame_seq, r.seq) for r in both.collect()) == [(2, 0), (3, 1)]


def test_frames_of_any_length_keep_their_order(spark):
    """More than 65,536 elements in a frame, absent prices, and frames that land out of order."""
    from pyspark.sql import functions as F
    many = spark.range(70_000).select(F.to_json(F.collect_list(F.struct(
        F.lit("XQ").alias("ev"), F.lit("A-B").alias("pair"), F.col("id").cast("double").alias("bp"), F.lit(6).alias("x")))).alias("value"))
    frames = many.select(F.lit(5).cast("long").alias("frame_seq"), "value").unionByName(spark.createDataFrame(
        [(6, json.dumps([quote("A-B", 70_000.0, 1, T0, 6)])), (2, json.dumps([quote("A-B", -1.0, 1, T0, 6)]))],
        "frame_seq long, value string"))
    got = quotes_json.live_frames(frames).orderBy("seq").select("seq", "bp", "ap", "as").collect()
    assert [r.seq for r in got] == list(range(70_002))
    assert [r.bp for r in got] == [float(i) for i in range(-1, 70_001)]
    assert got[1].ap == 0 and got[1]["as"] == 0


def test_period_parsing(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-02-01 10:00:00"), ("yesterday", "2024-01-01")],
                               "start string, end string")
    got = [(r.start_ts is not None, r.end_ts is not None, r.error) for r in dates.period_requests(df).collect()]
    assert got == [(True, True, None), (False, True, dates.MSG_INVALID_DATES)]


def test_array_file_by_byte_ranges(spark):
    """One file read by many tasks, equal to multiLine: pretty-printed, with braces, quotes and escapes in texts, and
    objects within objects."""
    import random
    r = random.Random(9)
    plain = [quote(f"P{i % 7}", i / 4, i / 4 + 1, T0 + i, i % 3) for i in range(4000)]
    hard = [dict(q, pair=r.choice(["a}b", "{", '"}', "x\\", "}}{", "\\\"{é", "A-B"]), more={"deep": {"p": "}"}, "list": [1, {}]})
            if r.random() < .5 else q for q in plain]
    from quoteflow import schemas
    cols = [f.name for f in schemas.QUOTE.fields]
    for items, indent in ((plain, None), (plain, 2), (hard, None), (hard, 3), (hard[:1], None), ([], None)):
        d = tempfile.mkdtemp(prefix="qf-array-")
        with open(os.path.join(d, "quotes.json"), "w") as f:
            json.dump(items, f, indent=indent, ensure_ascii=False)
            f.write("\n")
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        try:
            if len(items) > 1:
                assert quotes_json.array_elements(spark, d).select("block").distinct().count() > 4
            got = [tuple(x) for x in quotes_json.read_quote_array(spark, d).orderBy("seq").select("seq", *cols).collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        want = [tuple(x) for x in quotes_json.read_quote_file(spark, d).select(*cols).collect()]
        assert got == [(i, *x) for i, x in enumerate(want)] and len(got) == len(items)


def test_arrays_land_one_file_a_task_in_order(spark, scratch_dir):
    """Files that hash alike or are small aren't one task's, and the tenth file isn't read before the second."""
    d = os.path.join(scratch_dir, f"arrays-{time.time_ns()}")
    q = spark.range(-35, 85).selectExpr("id AS seq", "'XQ' AS ev", "'A-B' AS pair", "id AS t", "6 AS x")
    quotes_json.land_arrays(q, d, 10)
    folders = sorted(x for x in os.listdir(d) if x.startswith("file="))
    parts = [f.split("-")[1] for x in folders for f in os.listdir(os.path.join(d, x)) if f.startswith("part-")]
    assert len(folders) == len(parts) == len(set(parts)) == 13
    got = [tuple(r) for r in quotes_json.read_quote_array(spark, d + "/*").orderBy("seq").select("seq", "t").collect()]
    assert got == [(i, i - 35) for i in range(120)]
