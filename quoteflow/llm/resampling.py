"""Operator 13: target-distribution importance resampling over hashed n-grams.

1. A 256-byte table lower-cases A-Z and blanks every separator in a text's UTF-8
   bytes; ``bytes.split`` gives the words. Chained ``zlib.crc32`` seeds extend a word's
   hash to the runs of two and three words that start with it, so that no run is put
   together. A feature's bucket is its hash modulo the buckets.
2. Every task counts its features in one ``Counter`` (an entry a bucket at most), and
   the partial counts are added in Spark, for the rows and for the target texts. The
   sums, one row a bucket, come to the driver: that bound is the parameter ``buckets``.
3. A second pass adds the buckets' gains over each text and the row's keyed Gumbel
   noise, and writes one narrow row a document.
4. Those rows are sorted globally (a range partitioning that ends in the row number, so
   that ties spread too); a row's place is its place in its partition plus the rows of
   the partitions before, of which there is one count each. No window, no join.

A text is worked on in runs of about CHUNK bytes that end between words, with the
last two words carried over, so memory holds one text and the hashes of one run.

Defined results: a null text has no words; a null doc_id hashes as the empty string
and is the last of its ties; rows repeated with the same doc_id are scored and drawn
each (equal ones in any order); other columns are ignored; an empty table gives no rows, an
empty target leaves every gain to the smoothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import read, stage

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
CHUNK = 1 << 20
PLACE = (1 << 33) - 1             # a monotonic id holds the partition above these bits

#: Every byte's stand-in: a-z for A-Z; digits, a-z and bytes from 0x80 on stay; a space for all else.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def hashed_runs(body: bytes, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """(words, crc32 of every run of one to three words) of successive parts of a text."""
    text, tail, a = body.translate(TABLE), [], 0
    while a < len(text):
        z = text.find(b" ", a + chunk) if len(text) - a > chunk else -1
        z = len(text) if z < 0 else z
        new = text[a:z].split()
        a = z
        if not new:
            continue
        words, k = tail + new, len(tail)
        spaced = [b" " + w for w in words]
        ones = list(map(crc32, words))
        twos = list(map(crc32, spaced[1:], ones))
        threes = list(map(crc32, spaced[2:], twos))
        yield len(new), np.array(ones[k:] + twos[max(k - 1, 0):] + threes[max(k - 2, 0):], np.uint32)
        tail = words[-2:]


def bodies(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts of ``df`` by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for body in b.column(0).to_pylist():
                for _, runs in hashed_runs(body):
                    seen.update((runs % buckets).tolist())
        if seen:
            yield pa.RecordBatch.from_pydict({"bucket": list(seen), "n": list(seen.values())})

    rows = bodies(df).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:                                              # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to source, by bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of the row's Gumbel draw."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1)):
                words = features = weight = 0
                for n, runs in hashed_runs(body.as_py()):
                    words, features = words + n, features + len(runs)
                    weight += int(gain[runs % buckets].sum())
                out.append((doc_id, words, features, weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    scored = bodies(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long, score long")
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "resampling-scored")
    # rows that can be drawn come first, by falling score
    by = [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    placed = stage(scored.repartitionByRange(*by).sortWithinPartitions(*by)
                   .withColumn("at", F.monotonically_increasing_id()), "resampling-sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = {r["part"]: r for r in placed.groupBy("part").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_words") >= least_words).alias("can")).collect()}   # a row a partition
    drawn, total, bases = percent * sum(r["can"] for r in counts.values()) // 100, 0, []
    for p in sorted(counts):
        bases.append((p, total))
        total += counts[p]["n"]
    bases = docs.sparkSession.createDataFrame(bases, "part long, base long")
    rank = F.col("base") + F.col("at").bitwiseAND(F.lit(PLACE)) + 1
    return (placed.join(F.broadcast(bases), "part")
            .select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
