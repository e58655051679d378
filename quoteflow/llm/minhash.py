"""Operator 8: near-dedup by SuperMinHash signatures.

A document's set holds its distinct word shingles, as 64-bit hashes. All steps
j of the SuperMinHash permutation run for the elements of many documents at
once: at step j an element draws a rank and the slot its own permutation has at j
(a Fisher-Yates swap); a slot filled at an earlier step holds a smaller value
and stays. A document stops at the step that fills its last slot. Ranks of one
element never meet in a slot, hence the lower variance than MinHash's.

1. Documents with equal sets form a class (one aggregate on the set's size
   and a 128-bit digest, combined before the shuffle); only its smallest id goes on.
2. BANDS x ROWS slots are banded. At similarity 0.85 a pair misses all 24 bands of 5
   with probability (1 - 0.85^5)^24 < 1e-6.
3. Buckets are worked through in rounds, with GROWTH times the centres in each, from 1: each
   bucket's smallest ids not yet tried are compared with all later members of other
   components, on full sets. Then components are found again, and buckets with one
   component left are done. A large group of near copies is settled by its first
   centres, in pairs linear in its size; no bucket is cut, and a bucket of
   texts that do not link is compared completely.

Defined results: null, empty and blank texts have n_shingles 0 and link with
nothing; a null doc_id links with nothing and is kept, its component null; rows of
one doc_id are one vertex; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import components, discard, read, slices, stage, texts_of

BANDS, ROWS = 24, 5
#: A round costs some forty shuffles, whatever is left in it.
GROWTH = 64
#: 64-bit words of a parity sketch.
SKETCH = 16
WORDS_HELD = 500_000
#: Elements whose permutations are held at a time.
ELEMENTS = 1 << 17
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    """Hashes of words; forgets all when it holds too many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str, k: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text."""
    found = text.encode().lower().split()        # bytes: ASCII case and ASCII white space only
    if not found:
        return np.empty(0, U)
    w = np.fromiter(map(words.__getitem__, found), U, len(found))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, U)
    for i in range(k):
        h = mix(h * U(0x9E3779B97F4A7C15) + w[i:i + n])
    return np.unique(h)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (documents x m) of non-empty sets."""
    sig = np.full((len(sets), m), np.iinfo(U).max, U)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    e = np.concatenate(sets) if sets else np.empty(0, U)
    p = None
    for j in range(m):
        if not len(e):
            break
        x = mix(e + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = j + ((x >> U(44)) * U(m - j) >> U(20)).astype(np.int64)
        value = (U(j) << U(44)) | (x & U((1 << 44) - 1))
        at = np.arange(len(e))
        slot = k if p is None else p[at, k].astype(np.int64)
        np.minimum.at(sig.reshape(-1), doc * m + slot, value)
        left = (sig == np.iinfo(U).max).any(axis=1)[doc]
        if not left.any():
            break
        if p is None:
            p = np.broadcast_to(np.arange(m, dtype=np.uint16), (int(left.sum()), m)).copy()
            p[np.arange(len(p)), k[left]] = 0
        else:
            p[at, k] = p[:, j]
            p = p[left]
        e, doc = e[left], doc[left]
    return sig


def _bounded(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures in blocks. A set over the block size is signed in parts: the
    least value of each slot; a slot that all parts fill at their own steps
    has the whole set's value."""
    out = [np.empty((0, m), U)]
    for a, b in slices([len(s) for s in sets], ELEMENTS):
        block = sets[a:b]
        if b - a == 1 and len(block[0]) > ELEMENTS:
            parts = np.array_split(block[0], len(block[0]) // ELEMENTS + 1)
            out.append(np.min([superminhash([x], m) for x in parts], axis=0))
        else:
            out.append(superminhash(block, m))
    return np.concatenate(out)


def parity(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as SKETCH longs."""
    bits = np.bincount((mix(s) % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (digest of the set), bands and sketch (array<long>)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                sets = [shingles(t, k, words) for t in c.column(1).to_pylist()]
                sig = np.zeros((len(sets), bands * rows), U)
                has = np.flatnonzero([len(s) for s in sets])
                if len(has):
                    sig[has] = _bounded([sets[i] for i in has], bands * rows)
                h = np.zeros((len(sets), bands), U)
                for r in range(rows):
                    h = mix(h * U(0x9E3779B97F4A7C15) + sig.reshape(len(sets), bands, rows)[:, :, r])
                d = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                one = lambda v: pa.array(np.array(v, U).view(np.int64))
                flat = pa.array(h.reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                sketch = pa.array([parity(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), pa.array([len(s) for s in sets], pa.int64()), one([x >> 64 for x in d]),
                     one([x & (1 << 64) - 1 for x in d]), pa.ListArray.from_arrays(offsets, flat), sketch],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    return texts_of(docs).mapInArrow(part, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, "
                                     "sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, h1 (of the digest) and the set (array<long>)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                sets = [shingles(t, k, words) for t in c.column(1).to_pylist()]
                h1 = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) >> 64 for s in sets], U).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), pa.array(h1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["id", "h1", "set"])

    return docs.select("doc_id", "text").mapInArrow(part, "id long, h1 long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, ah, b, bh) that link on their full sets."""
    one = sets.select(F.col("id").alias("b"), F.col("h1").alias("bh"), F.col("set").alias("sb"))
    two = sets.select(F.col("id").alias("a"), F.col("h1").alias("ah"), F.col("set").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(one, ["b", "bh"]).join(two, ["a", "ah"])
            .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept. Links:
    100 * intersection >= percent * union."""
    sig = stage(signed(docs, k, bands, rows), "minhash-signed")
    key = ["n_shingles", "h1", "h2"]
    usable = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stage(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"),
                                                F.min("sketch").alias("sketch")), "minhash-classes")
    bucket = classes.select(F.col("rep").alias("id"), F.col("h1"), F.col("n_shingles").alias("n"),
                            F.posexplode("bands").alias("band", "h"))
    shared = bucket.groupBy("band", "h").agg(F.count("*").alias("m")).where("m > 1").select("band", "h")
    sketches = classes.select(F.col("rep").alias("id"), "h1", "sketch")
    left = stage(bucket.join(shared, ["band", "h"]), "minhash-buckets")
    sets = stage(full_sets(texts_of(docs).join(left.select(F.col("id").alias("doc_id")).distinct(), "doc_id",
                                               "left_semi"), k).dropDuplicates(["id", "h1"]), "minhash-sets")
    # Rows of one doc_id with several texts tie their classes together.
    twice = usable.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x < y").select("doc_id")
    links = stage(usable.join(twice, "doc_id", "left_semi").join(classes.drop("bands", "sketch"), key)
                  .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "minhash-links")
    comp, centres, upto = components(links, "minhash"), 1, None
    discard(links)
    while True:
        now = left.join(comp, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
        open_ = now.groupBy("band", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        now = now.join(open_.select("band", "h"), ["band", "h"])
        now = now.withColumn("upto", F.lit(None).cast("long")) if upto is None else now.join(upto, ["band", "h"], "left")
        # Ids up to ``upto`` have been centres: they were compared with all members after them.
        now = stage(now.where("upto is null or id > upto").drop("upto"), "minhash-open")
        discard(left)
        order = Window.partitionBy("band", "h").orderBy("id", "h1")
        heads = (now.select("band", "h", F.col("id").alias("a"), F.col("h1").alias("ah"), F.col("n").alias("an"),
                            F.col("c").alias("ac"), "id", "h1")
                 .withColumn("k", F.row_number().over(order)).where(F.col("k") <= centres).drop("id", "h1", "k"))
        heads = stage(heads, "minhash-heads")
        if heads.isEmpty():
            break
        # Sketches are wide: rows of open buckets get theirs for this join alone.
        asketches = sketches.select(F.col("id").alias("a"), F.col("h1").alias("ah"), F.col("sketch").alias("asketch"))
        differ = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("asketch")[i])) for i in range(SKETCH))
        pairs = (now.join(sketches, ["id", "h1"]).join(heads.join(asketches, ["a", "ah"]), ["band", "h"])
                 .where("(id > a or id = a and h1 > ah) and c <> ac")
                 .where(100 * F.least("n", "an") >= percent * F.greatest("n", "an"))
                 .where(differ * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("an")))
                 .select("a", "ah", F.col("id").alias("b"), F.col("h1").alias("bh")).distinct())
        found = stage(_verified(pairs, sets, percent), "minhash-links")
        if not found.isEmpty():
            # The components so far stand for all links before.
            last, comp = comp, components(found.union(comp.select("id", "component_id")), "minhash")
            discard(last)
        discard(found)
        tried = heads.groupBy("band", "h").agg(F.max("a").alias("upto"))
        last = upto
        upto = tried if upto is None else upto.union(tried).groupBy("band", "h").agg(F.max("upto").alias("upto"))
        upto = stage(upto, "minhash-upto")
        discard(last, heads)
        # A bucket's tried members are out of the next rounds.
        left = now.drop("c")
        left.staged = now.staged
        centres *= GROWTH
    discard(sets, upto, now, heads)
    rep = sig.drop("bands", "sketch").join(classes.drop("bands", "sketch"), key, "left")
    out = (rep.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
           .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                       .when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), k=3, percent=85)
