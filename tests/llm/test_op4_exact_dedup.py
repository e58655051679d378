"""Exact dedup against brute force, and the trie on its own."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteflow.llm.exact_dedup import Patricia, op4_exact_dedup, owned, owners, scanned

SF = "/root/testdata/sf0.001"


@given(st.lists(st.binary(max_size=6), max_size=40))
def test_trie_holds_each_string_once(keys):
    t = Patricia()
    for k in keys:
        n = t.insert(k)
        n[1] = (n[1] or 0) + 1
    assert dict(t.terminals()) == {k: keys.count(k) for k in keys}


@given(st.lists(st.binary(max_size=5), max_size=40), st.integers(1, 9))
def test_subtrees_are_spilled_once_finished(keys, every):
    """In sorted order, what is spilled before the newest text never comes again; nothing is lost."""
    t, out = Patricia(), []
    for i, k in enumerate(sorted(keys)):
        n = t.insert(k)
        n[1] = (n[1] or 0) + 1
        if i % every == 0:
            out += t.before(k)
            assert [x for x, _ in t.terminals()] == [k]
    out += t.terminals()
    assert len(dict(out)) == len(out) and dict(out) == {k: keys.count(k) for k in keys}


def test_cut_takes_one_subtree():
    t = Patricia()
    for k in (b"", b"romane", b"romanus", b"rom", b"so"):
        t.insert(k)[1] = 1
    assert {x for x, _ in t.cut(ord("r"))} == {b"romane", b"romanus", b"rom"}
    assert {x for x, _ in t.terminals()} == {b"", b"so"}


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    return sorted((d, max(g), len(g), d == max(g), hashlib.sha256((t or "").encode()).hexdigest())
                  for d, t in rows for g in [groups[t or ""]])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op4_exact_dedup(spark, SF).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 500_000), (4, "x" * 500_000), (5, " x"), (6, "x")]
    rows += [(i, "same") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("row", F.lit(""))
    assert sorted(map(tuple, owners(df.repartition(5)).drop("row").collect())) == brute(rows)
    assert owners(df.where("false")).count() == 0
    low = owners(df, keep="min").where("kept").collect()
    assert {r["doc_id"] for r in low} == {1, 3, 5, 6, 100}
    again = spark.createDataFrame([(7, "a"), (7, "a"), (None, "a"), (None, "b"), (None, "b")], df.schema[:2])
    got = owners(again).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["keep_id"] for r in got if r["group_size"] == 3} == {7}


def test_spills_do_not_change_results(spark):
    """With room for hardly any text, subtrees go out early in scan and owner partitions, and texts
    come again; the trie, not the hash, finds the equals: with one digest for all the groups are the same."""
    rows = [(i, "abcd"[i % 4] + "same begin " * (i % 3) + str(i % 23)) for i in range(600)] + [(700, ""), (701, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for spill in (1, 1500):
        assert sorted(map(tuple, owners(df, spill=spill).drop("row").collect())) == brute(rows)
    seen = scanned(df, max, 1500).persist()
    terminals = seen.where("copies is not null")
    assert terminals.count() > terminals.select("body").distinct().count()
    got = owned(terminals.withColumn("sha", F.lit("0" * 64)), max, 1500)
    docs = seen.where("copies is null").drop("copies").join(got, "term").select("doc_id", "keep_id", "copies")
    assert sorted(map(tuple, docs.collect())) == [x[:3] for x in brute(rows) if x[2] > 1]
    seen.unpersist()
