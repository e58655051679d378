"""Corpus pipeline: toxicity filter, exact dedup, MinHash near-dedup, packing.

Every stage is written as Parquet to the shared folder and read again as the
next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quoteflow.llm.common import read, stage
from quoteflow.llm.exact_dedup import owners
from quoteflow.llm.minhash import near_groups
from quoteflow.llm.packing import pack
from quoteflow.llm.toxicity import clean


def toxicity(spark, docs, sf_dir):
    """Documents that the toxicity model does not reject."""
    return clean(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    """One document of each set of equal texts: the one with the largest doc_id."""
    kept = owners(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    sha = docs.withColumn("sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return (sha.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")),
                     "left_semi")
            .dropDuplicates(["doc_id", "sha"]).select(*docs.columns))


def minhash(spark, docs, sf_dir):
    """One document of each group of near copies (five words, 0.8): the smallest doc_id."""
    dropped = near_groups(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


#: Documents a partition that is packed as one, about; and the most partitions.
PACKED_TOGETHER, MOST_PARTS = 4096, 200_000


def packing(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens of every document that is left. Documents
    are dealt by doc_id into parts whose count follows from the rows, so that the
    windows do not depend on how the stages before were partitioned."""
    parts = min(max(-(-docs.count() // PACKED_TOGETHER), 1), MOST_PARTS)
    dealt = docs.select("doc_id", "text").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return pack(dealt, keep_ids=False)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash", minhash), ("packing", packing)]

#: The toxicity model and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
