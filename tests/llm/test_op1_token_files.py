"""Token files: exact ids, offsets and bases against direct encoding."""

import json
import zlib

import numpy as np
from pyspark.sql import functions as F

from quoteflow.llm.common import new_path, tokenizer
from quoteflow.llm.token_files import END_ID, TOKENIZER, document, mapped, op1_token_files, read_tokens, write_tokens

SF = "/root/testdata/sf0.001"


def expected(rows):
    tok, at, out = tokenizer(TOKENIZER), 0, []
    for k, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [END_ID], "<u4")
        out.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_matches_direct_encoding(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op1_token_files(spark, SF).collect())
    assert got == expected(sorted((r[0], r[1]) for r in rows))


def test_parts_bases_and_odd_rows(spark):
    data = [(3, None), (1, ""), (2, "long words " * 30000), (None, "null id"), (1, ""), (5, "ünï 漢字 <|endoftext|>")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("start", F.lit(9))
    path = new_path(spark, "t")
    parts = write_tokens(df, path)
    assert json.load(open(f"{path}/index.json")) == parts
    assert [p["base"] for p in parts] == [0, *np.cumsum([p["tokens"] for p in parts])[:-1].tolist()]
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    key = lambda r: r[1]
    assert sorted(map(tuple, read_tokens(spark, path, parts).collect()), key=key) == expected(order)
    for p in parts:                              # the end id closes every document
        o = mapped(f"{path}/{p['name']}.offsets", "<i8")
        assert len(o) == p["docs"] + 1 and o[-1] == p["tokens"]
        assert all(document(path, p, i)[-1] == END_ID for i in range(p["docs"]))


def test_wide_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    path = new_path(spark, "t")
    parts = write_tokens(df, path, end_id=1 << 20)
    assert parts[0]["dtype"] == "<u4" and document(path, parts[0], 0)[-1] == 1 << 20
    path = new_path(spark, "t")
    parts = write_tokens(df.where("false"), path)
    assert parts == [] and read_tokens(spark, path, parts).count() == 0
