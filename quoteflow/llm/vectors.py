"""Operator 5: embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors form a class (one aggregate, combined before the shuffle); its
   smallest id stands for it.
2. Spherical k-means, fitted on at most SAMPLE classes (those with the smallest id
   hashes), gives clusters. Every class joins the BUILD nearest clusters, so clusters
   overlap; a cluster of more than SHARD members is split by hash, so no task
   holds an unbounded group.
3. Each shard builds a flat graph: a node's nearest members are robustly pruned to
   DEGREE neighbours. The adjacency lists of a class in all its shards are united;
   a search walks those of their edges that stay in its shard, both ways, none cut.
   Parts without an edge between them are joined to the medoid's.
4. Each class searches every shard of its PROBE nearest clusters: a greedy search of
   beam BEAM from the shard's medoid and from the class's own node, if it is a member,
   which then expands its range, every node within
   SLACK of the threshold, until nothing new is found. Queries come in blocks.
5. Candidates are verified by cosine in double precision.
6. Audit: one class in STRIDE, by the hash of its id, is compared with all classes,
   in blocks. With fewer than PROOF audited classes that have a link the audit takes
   more classes, all in the end. While the recall of found links is below RECALL (1
   where all classes were audited), probes double and the search is done again. When
   all clusters were probed and the audit still fails, all classes are compared in
   blocks, so the answer is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do those with a null vec_id, which are kept with a
null component; vectors of different lengths do not link; other columns are
ignored; an empty table gives no rows. n_links counts rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import components, discard, read, stage

SAMPLE, SHARD, PER_CLUSTER, BUILD, PROBE = 20_000, 1500, 800, 2, 3
DEGREE, ALPHA, BEAM, SLACK, BLOCK = 24, 1.2, 24, 0.05, 256
STRIDE, PROOF, RECALL = 50, 100, 0.99
COMPARED = 1 << 19           # vector components held at a time as queries of an exact comparison


def normal(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def parsed(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, digest and body (float64 bytes); null where a vector can't link."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, digests, bodies = [], [], []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], "<f8") + 0.0     # no negative zeros
                ok = len(x) and np.isfinite(x).all() and x.any()
                bodies.append(x.tobytes() if ok else None)
                digests.append(hashlib.sha256(bodies[-1]).hexdigest() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(digests, pa.string()),
                                              pa.array(bodies, pa.binary())], names=["vec_id", "dim", "digest", "body"])

    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
            .mapInArrow(part, "vec_id long, dim int, digest string, body binary"))


def kmeans(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample; deterministic."""
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = np.concatenate([(x[a:a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = np.linalg.norm(total, axis=1) > 0
        c[full] = normal(total[full])
    return c


def assigned(classes: DataFrame, centres: np.ndarray, nearest: int) -> DataFrame:
    """id, body, cluster for each of the nearest clusters."""
    n = min(nearest, len(centres))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                s = b.slice(a, 1024)
                x = normal(np.stack([np.frombuffer(v, "<f8") for v in s.column(1).to_pylist()])).astype("f4")
                near = np.argpartition(-(x @ centres.T), n - 1, axis=1)[:, :n]
                rows = pa.array(np.repeat(np.arange(len(x)), n))
                yield pa.RecordBatch.from_arrays([s.column(0).take(rows), s.column(1).take(rows),
                                                  pa.array(near.reshape(-1).astype("i4"))], names=["id", "body", "cluster"])

    return classes.select("id", "body").mapInArrow(part, "id long, body binary, cluster int")


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbour lists: nearest first, a kept neighbour rules out
    those it is ALPHA times closer to than the node is."""
    n, out = len(x), []
    near = min(n, 4 * DEGREE)
    for a in range(0, n, 512):
        sim = x[a:a + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
        order = np.argpartition(-sim, near - 1, axis=1)[:, :near]
        for i in range(len(sim)):
            o = order[i][np.argsort(-sim[i, order[i]], kind="stable")]
            o = o[sim[i, o] > -2]
            far = np.maximum(1 - sim[i, o], 0)
            between = np.maximum(1 - x[o] @ x[o].T, 0)
            alive, keep = np.ones(len(o), bool), []
            for j in range(len(o)):
                if alive[j]:
                    keep.append(o[j])
                    if len(keep) == DEGREE:
                        break
                    alive &= ALPHA * between[j] > far
            out.append(np.array(keep, int))
    return out


def walkable(rows: list[list[int]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The graph of neighbour lists, walked both ways, as (first, to): node i's
    neighbours are to[first[i]:first[i + 1]]; and the medoid. Every node can be
    reached from it: a part without an edge to the medoid's gets one, from its
    node nearest to the medoid."""
    both: list[dict[int, None]] = [dict.fromkeys(r) for r in rows]
    for i, r in enumerate(rows):
        for j in r:
            both[j][i] = None
    start = int((x @ x.mean(0)).argmax())
    near = np.argsort(-(x @ x[start]), kind="stable").tolist()
    seen = np.zeros(len(x), bool)
    for i in [start, *near]:
        if not seen[i]:
            if i != start:
                both[start][i] = both[i][start] = None
            seen[i], todo = True, [i]
            while todo:
                for j in both[todo.pop()]:
                    if not seen[j]:
                        seen[j] = True
                        todo.append(j)
    first = np.cumsum([0, *map(len, both)])
    return first, np.fromiter((j for r in both for j in r), int, first[-1]), start


def search(x: np.ndarray, first: np.ndarray, to: np.ndarray, start: int, own: np.ndarray, q: np.ndarray,
           least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with similarity of ``least`` or more that a greedy
    search finds, all queries in step. first, to: the graph; a query starts from
    ``start`` and from its own node, -1: none."""
    n, m = len(x), len(q)
    sim = np.full((m, n), -9, "f4")
    sim[:, start] = q @ x[start]
    has = np.nonzero(own >= 0)[0]
    sim[has, own[has]] = np.einsum("ij,ij->i", q[has], x[own[has]])
    done = np.zeros((m, n), bool)
    active, wide = np.arange(m), least - SLACK
    beam = min(BEAM, n)
    while len(active):
        s = sim[active]
        floor = np.partition(s, n - beam, axis=1)[:, n - beam]
        floor = np.minimum(np.where(floor > -9, floor, -8), wide)
        s[done[active]] = -9
        top = s.argmax(1)
        go = s[np.arange(len(active)), top] >= floor
        active, top = active[go], top[go]
        done[active, top] = True
        count = first[top + 1] - first[top]
        r = np.repeat(active, count)
        at = to[np.arange(len(r)) + np.repeat(first[top] - (np.cumsum(count) - count), count)]
        fresh = sim[r, at] == -9
        r, at = r[fresh], at[fresh]
        sim[r, at] = np.einsum("ij,ij->i", q[r], x[at])
    return np.nonzero(sim >= least)


def _matrix(bodies) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in bodies])


def _one_length(classes: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a < b) between classes whose vectors have one length."""
    classes = classes.select("id", "body")
    n = classes.count()
    some = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()        # the bounded sample
    x = normal(_matrix([r["body"] for r in some])).astype("f4")
    centres = kmeans(x, max(1, min(len(x) // 20, n // PER_CLUSTER)))
    members = stage(assigned(classes, centres, BUILD), "vec-members")
    split = members.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("splits"))
    members = members.join(F.broadcast(split), "cluster")                         # a row a cluster: SAMPLE / 20 at most
    members = stage(members.withColumn("sub", F.pmod(F.xxhash64("id", F.lit(3)), F.col("splits")).cast("int")), "vec-shards")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        lists = pruned(normal(_matrix(pdf["body"])).astype("f4"))
        return pd.DataFrame({"id": ids, "near": [ids[o].tolist() for o in lists]})

    lists = members.groupBy("cluster", "sub").applyInPandas(build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = stage(members.join(united, "id").select("cluster", "sub", "id", "body", "near"), "vec-graph")

    def find(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        if not len(pdf) or not len(asked):
            return none
        pdf = pdf.sort_values("id")
        ids, exact = pdf["id"].to_numpy(), normal(_matrix(pdf["body"]))
        x, place = exact.astype("f4"), {k: i for i, k in enumerate(ids.tolist())}
        first, to, start = walkable([[place[k] for k in near if k in place] for near in pdf["near"]], x)
        asked_ids, asked_x = asked["id"].to_numpy(), normal(_matrix(asked["body"]))
        out = []
        for a in range(0, len(asked_ids), BLOCK):
            q = asked_x[a:a + BLOCK]
            own = np.array([place.get(k, -1) for k in asked_ids[a:a + BLOCK].tolist()])
            i, j = search(x, first, to, start, own, q.astype("f4"), threshold - 1e-4)
            ok = np.einsum("ij,ij->i", q[i], exact[j]) >= threshold - 1e-9
            u, v, ui, vj = asked_ids[a + i[ok]], ids[j[ok]], asked["body"].to_numpy()[a + i[ok]], pdf["body"].to_numpy()[j[ok]]
            sure = linked(ui, vj, threshold) & (u != v)
            out.append(pd.DataFrame({"a": np.minimum(u, v)[sure], "b": np.maximum(u, v)[sure]}))
        return pd.concat([none, *out])

    true, whole = evidence(classes, n, x.shape[1], threshold)
    probes = PROBE
    while True:
        asked = assigned(classes, centres, probes).join(F.broadcast(split), "cluster")
        asked = asked.select("id", "body", "cluster", F.explode(F.expr("sequence(0, splits - 1)")).alias("sub"))
        # Blocks of queries, so that a hot cluster's queries spread over many tasks.
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / (8 * SHARD))).cast("int")
        per = asked.groupBy("cluster", "sub").agg(F.count("*").alias("n")).select("cluster", "sub", blocks.alias("blocks"))
        asked = (asked.join(per, ["cluster", "sub"])
                 .withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")))
        shards = (nodes.join(per, ["cluster", "sub"])
                  .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))))
        key = ("cluster", "sub", "block")
        pairs = (shards.select(*key, "id", "body", "near").groupBy(*key)
                 .cogroup(asked.select(*key, "id", "body").groupBy(*key)).applyInPandas(find, "a long, b long"))
        pairs = stage(pairs.distinct(), "vec-links")
        if audit(true, pairs) >= (1.0 if whole else RECALL):
            return pairs
        discard(pairs)
        if probes >= len(centres):
            if not whole:
                true = compared(classes, classes, n, x.shape[1], threshold)
            return true.select("a", "b").distinct()
        probes *= 2


def linked(u, v, threshold: float) -> np.ndarray:
    """Cosine in double precision, pair by pair."""
    if not len(u):
        return np.zeros(0, bool)
    a, b = _matrix(u), _matrix(v)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))) >= threshold


def compared(classes: DataFrame, some: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    """Links a < b of ``some`` (n rows) with all classes, pair by pair; q is the row of
    ``some``. Its vectors go out in blocks, one pass over the classes for each."""
    blocks = -(-n * dim // COMPARED) or 1
    out = None
    for k in range(blocks):
        block = some.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(blocks)) == k).select("id", "body").collect()
        if not block:
            continue
        ids, bodies = np.array([r["id"] for r in block]), np.array([r["body"] for r in block], object)
        x = normal(_matrix(bodies))

        def part(batches: Iterator[pa.RecordBatch], ids=ids, bodies=bodies, x=x) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, 256):
                    s = b.slice(a, 256)
                    v, w = s.column(0).to_numpy(), np.array(s.column(1).to_pylist(), object)
                    i, j = np.nonzero(normal(_matrix(w)) @ x.T >= threshold - 1e-9)
                    i, j = i[v[i] != ids[j]], j[v[i] != ids[j]]
                    for c in range(0, len(i), 4096):
                        f, t = i[c:c + 4096], j[c:c + 4096]
                        sure = linked(w[f], bodies[t], threshold)
                        f, t = v[f[sure]], ids[t[sure]]
                        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.minimum(f, t)), pa.array(np.maximum(f, t))],
                                                         names=["q", "a", "b"])

        links = stage(classes.select("id", "body").mapInArrow(part, "q long, a long, b long"), "vec-true")
        out = links if out is None else out.union(links)
    return out if out is not None else classes.selectExpr("id as q", "id as a", "id as b").where("false")


def evidence(classes: DataFrame, n: int, dim: int, threshold: float) -> tuple[DataFrame, bool]:
    """True links of the audited classes, of which PROOF have one, or of all classes
    (then True)."""
    stride = STRIDE
    while True:
        some = classes.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(stride)) == 0)
        true = compared(classes, some, some.count(), dim, threshold)
        if stride == 1 or true.select("q").distinct().count() >= PROOF:
            return true, stride == 1
        stride = max(1, stride // 8)


def audit(true: DataFrame, pairs: DataFrame) -> float:
    """Share of the true links that were found."""
    got = true.select("a", "b").distinct().join(pairs.withColumn("found", F.lit(1)), ["a", "b"], "left")
    r = got.agg(F.count("*").alias("n"), F.count("found").alias("found")).first()
    return r["found"] / r["n"] if r["n"] else 1.0


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = stage(parsed(vectors), "vec-rows")
    usable = rows.where("vec_id is not null and digest is not null")
    classes = stage(usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"),
                                                 F.min("dim").alias("dim"), F.min("body").alias("body")), "vec-classes")
    dims = [r["dim"] for r in classes.select("dim").distinct().collect()]           # lengths of vectors: a few
    pairs = None
    for d in sorted(dims):
        p = _one_length(classes.where(F.col("dim") == d), threshold)
        pairs = p if pairs is None else pairs.union(p)
    if pairs is None:
        pairs = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    comp = components(pairs, "vec")
    both = pairs.union(pairs.select("b", "a"))
    links = (both.join(classes.select(F.col("id").alias("b"), "w"), "b").groupBy("a").agg(F.sum("w").alias("others"))
             .withColumnRenamed("a", "id"))
    of = (classes.select("digest", "id", "w").join(links, "id", "left").join(comp, "id", "left")
          .select("digest", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                  F.coalesce("component_id", "id").alias("component_id")))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(of, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
