"""Near-dedup against all pairs by brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quoteflow.llm import common, minhash
from quoteflow.llm.minhash import Words, near_groups, op8_minhash, shingles, superminhash

from .brute import near_copies as brute

SF = "/root/testdata/sf0.001"


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op8_minhash(spark, SF).collect())) == brute(rows, 3, 85)


def test_chains_ties_and_odd_rows(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One"), (5, "one"), (6, "one two"), (7, "É x"), (8, "é x")]
    for g in range(3):
        t = r.choices(words, k=150)
        for i in range(30):                                  # a chain: each text a small step from the one before
            t = list(t)
            t[r.randrange(150)] = f"n{g}-{i}"
            rows.append((100 * (g + 1) + i, " ".join(t)))
    rows += [(900 + i, "the same text " * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(0)).withColumn("set", F.lit(""))
    for k, percent in ((3, 85), (5, 80)):
        assert sorted(map(tuple, near_groups(df, k, percent).collect())) == brute(rows, k, percent)
    assert near_groups(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "q"), (9, "q")], df.schema[:2])
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_groups(odd).collect()}
    assert got == {(None, None, True), (3, 3, True), (9, 3, False)}


def test_signature_estimates_similarity():
    words = Words()
    a = shingles(" ".join(f"w{i}" for i in range(1000)), 1, words)
    b = shingles(" ".join(f"w{i}" for i in range(200, 1200)), 1, words)
    s = superminhash([a, b], 400)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.07
    tiny = superminhash([a[:1]], 64)[0] >> np.uint64(44)
    assert sorted(tiny.tolist()) == list(range(64))          # one element fills every slot, each at its own step


def staged(monkeypatch, module):
    names, plain = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: names.append(name) or plain(df, name))
    return names


def test_stars_take_no_round(spark, monkeypatch):
    """Links of one centre are components already; a chain takes some rounds, and gives the same answer."""
    names = staged(monkeypatch, common)
    star = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(40, 41), (41, 40), (7, 7)], "a long, b long")
    assert sorted(map(tuple, common.components(star, "t").collect())) == [(i, 1) for i in range(1, 30)] + [(40, 40), (41, 40)]
    assert names == ["t-edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)], "a long, b long")
    assert sorted(map(tuple, common.components(chain, "t").collect())) == [(i, 0) for i in range(61)] + [(i, 100) for i in (100, 101, 102)]
    assert common.components(star.where("false"), "t").count() == 0


def test_a_bucket_takes_few_rounds(spark, monkeypatch):
    """Texts that share every bucket and don't link are all compared, in rounds that grow fast."""
    monkeypatch.setattr(minhash, "signed", lambda docs, k, bands, rows, plain=minhash.signed: plain(docs, k, bands, rows)
                        .withColumn("bands", F.expr("transform(bands, x -> if(x = 0, 0L, 1L))")))
    r, rows = random.Random(9), []
    for g in range(30):
        t = [f"g{g}w{r.randrange(9)}" for _ in range(60)]
        rows += [(3 * g + i, " ".join([*t, f"end{i}"])) for i in range(3)]
    names = staged(monkeypatch, minhash)
    got = sorted(map(tuple, near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()))
    assert got == brute(rows, 3, 85) and len({c for _, _, c, _ in got}) == 30
    assert names.count("minhash-links") <= 4         # three rounds, and the links of repeated ids
