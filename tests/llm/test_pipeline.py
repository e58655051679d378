"""The pipeline against its operators' brute force on the small tables."""

import corpus_pipeline
from quoteflow.llm.toxicity import clean

from .brute import near_copies

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = clean(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    last = {}
    for r in left:
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    kept = [r for r in left if last[r["text"] or ""] == r["doc_id"]]
    want = {d for d, _, _, k in near_copies([(r["doc_id"], r["text"]) for r in kept], 5, 80) if k}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == want
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns and f(spark, docs.where("false"), SF).count() == 0, name
