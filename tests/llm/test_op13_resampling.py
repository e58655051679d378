"""Importance resampling against a plain restatement."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteflow.llm.resampling import TABLE, hashed_runs, op13_importance_resampling, resample

SF = "/root/testdata/sf0.001"


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    runs = [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target):
    """doc_id, n_features, weight, score, rank by definition."""
    s = Counter(b for _, t in docs for b in features(t)[1])
    t = Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows, can = [], []
    for d, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            can.append(rows[-1])
    can.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(can[:5 * len(can) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = got(op13_importance_resampling(spark, sf))
    assert rows == brute(docs, target) and sum(r[4] is not None for r in rows) > 0


def test_parts_of_long_texts_join():
    text = ("Ünder ab-c, 12x\x00" * 500 + "longword" * 40 + " É é\tZ\n").encode()
    whole = [x for _, x in hashed_runs(text, 1 << 20)]
    for chunk in (1, 7, 64, 1000):
        parts = list(hashed_runs(text, chunk))
        assert sum(n for n, _ in parts) == len(text.translate(TABLE).split())
        assert Counter(np.concatenate([x for _, x in parts]).tolist()) == Counter(whole[0].tolist())
    assert list(hashed_runs(b"")) == [] and list(hashed_runs(b" .,;\x7f")) == []


def test_ties_nulls_and_odd_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "... !!"), (None, "a b c " * 20), (None, "a b c " * 20), (7, long), (7, long)]
    rows += [(10 + i, "same words here " * 10) for i in range(60)] + [(8, "Zürich 日本語 x" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumn("rank", F.lit(5)).withColumn("body", F.lit("x")).withColumn("weight", F.lit(None).cast("int"))
    target = ["same words there", None, "日本語"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    assert got(resample(clash, t)) == brute(rows, target)
    assert got(resample(df.where("false"), t)) == []
    assert got(resample(df, t.where("false"))) == brute(rows, [])
    assert [r[4] for r in got(resample(df, t, percent=0))] == [None] * len(rows)
    every = [r["rank"] for r in resample(df, t, percent=100, least_words=0).collect()]
    assert sorted(every) == list(range(1, len(rows) + 1))
