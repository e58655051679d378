"""Embedding near-dedup against all pairs by brute force."""

import numpy as np

from quoteflow.llm import vectors as V
from quoteflow.llm.vectors import near_vectors, op5_vectors

SF = "/root/testdata/sf0.01"


def brute(rows, t=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows
          if v and None not in v and np.isfinite(v).all() and np.any(v)]
    root = {i: i for i, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, u) in enumerate(ok):
        for j, v in ok[n + 1:]:
            if len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= t:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, links[i], find(i), find(i) == i) for i, _ in rows)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_vectors(spark, SF).collect())) == brute(rows)


def test_split_clusters_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 40)
    monkeypatch.setattr(V, "PER_CLUSTER", 60)
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    rows = [(i, (base[i % 30 if i % 2 else 0] + r.normal(size=16) * 0.2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)] + [(2000, (2 * np.array(rows[5][1])).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] + [1.0] * 15),
             (3005, [1.0, 0.0]), (3006, [2.0, 0.0]), (3007, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "0 as body")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute(rows)
    assert near_vectors(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, [1.0]), (4, [1.0]), (4, [1.0])], df.schema[:2])
    assert sorted(map(str, near_vectors(odd).collect())) == sorted(
        ["Row(vec_id=None, n_links=0, component_id=None, kept=True)"] + ["Row(vec_id=4, n_links=1, component_id=4, kept=True)"] * 2)


def test_links_the_search_misses(spark, monkeypatch):
    """One cluster only, and a search that finds nothing: the audit must notice."""
    monkeypatch.setattr(V, "search", lambda *a: (np.empty(0, int), np.empty(0, int)))
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 12))
    rows = [(i, (base[i % 60] + r.normal(size=12) * 0.05).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for stride, proof in ((50, 100), (2, 10)):       # all classes audited; a part of them
        monkeypatch.setattr(V, "STRIDE", stride, raising=False)
        monkeypatch.setattr(V, "PROOF", proof, raising=False)
        assert sorted(map(tuple, near_vectors(df).collect())) == brute(rows)


def test_too_few_links_are_no_proof(spark, monkeypatch):
    """Two links among 300 vectors, missed by the search and by any small sample."""
    monkeypatch.setattr(V, "search", lambda *a: (np.empty(0, int), np.empty(0, int)))
    monkeypatch.setattr(V, "PER_CLUSTER", 10)        # over three clusters, so that the old audit ran
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=24).tolist()) for i in range(300)]
    rows += [(1000 + i, (np.array(rows[i][1]) * 1.001 + 1e-3).tolist()) for i in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute(rows)


def test_clump_away_from_the_medoid(spark, monkeypatch):
    """150 near copies whose lists hold nothing else, in a shard whose medoid is far
    away: the graph search by itself, the audit taken out, finds their links."""
    monkeypatch.setattr(V, "audit", lambda *a: 1.0)
    r = np.random.default_rng(6)
    far, clump = np.eye(16)[0] * 4, np.eye(16)[1] * 4
    rows = [(i, (far + r.normal(size=16) * 0.8).tolist()) for i in range(400)]
    rows += [(1000 + i, (clump + r.normal(size=16) * 0.05).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute(rows)


def test_every_node_is_reached():
    r = np.random.default_rng(7)
    x = V.normal(r.normal(size=(60, 8))).astype("f4")
    first, to, start = V.walkable([[0] if i % 2 else [(i + 2) % 60] for i in range(50)] + [[] for _ in range(10)], x)
    seen, todo = {start}, [start]
    while todo:
        i = todo.pop()
        new = set(to[first[i]:first[i + 1]].tolist()) - seen
        seen |= new
        todo += new
    assert len(seen) == 60
    i, j = V.search(x, first, to, start, np.arange(60), x, 0.9999)     # from their own nodes
    assert set(range(60)) <= set(i[i == j].tolist())
