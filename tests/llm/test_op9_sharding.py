"""Sharding: the law, the mixture and a plain restatement."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quoteflow.llm.sharding import interleave, op9_sharding

SF = "/root/testdata/sf0.01"


def checked(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == n and all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_sharding(spark, SF).collect()
    checked(rows, len(docs), 40)
    for r in rows:
        body = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "rows", None)


@pytest.mark.parametrize("partitions", [1, 7])
def test_mixture_and_same_rows_at_any_partitioning(spark, partitions):
    data = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 9}") for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("place", F.lit("x"))
    rows = interleave(df.repartition(partitions), 12).collect()
    checked(rows, 1200, 12)
    for source, n in Counter(s for _, _, s in data).items():
        per = Counter(r["shard"] for r in rows if r["source"] == source)
        assert all(abs(per[s] - n / 12) <= 1.01 for s in range(12))
    key = sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    assert key == sorted((r["doc_id"], r["shard"], r["slot"]) for r in interleave(df, 12).collect())


def test_odd_rows(spark):
    data = [(1, None, None), (1, None, None), (None, "", "a"), (2, "é" * 100_000, "a"), (3, "x", "n")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = interleave(df, 40).collect()
    checked(rows, 5, 40)
    assert max(r["size"] for r in rows) == 200_016 and min(r["size"] for r in rows) == 16
    assert interleave(df.where("false")).count() == 0
