"""Operator 1: token ids as flat binary files.

A dataset is a folder of parts. A part holds three flat little-endian files:
``tokens`` (unsigned 16- or 32-bit ids, by vocabulary size), ``offsets``
(64-bit: where each document starts within the part, and the part's end) and
``docs`` (64-bit document ids). Parts follow each other in ascending doc_id
order; a part's base, the number of ids in all parts before it, is a prefix
sum over the parts' counts, so a document's global start is base + offset.

Documents are range-partitioned by doc_id and each task streams its part to
the shared folder under a name of its own attempt. The attempt's name comes
back with the part's counts; only named files belong to the dataset, so a
retried or duplicated task does no harm. The driver sees one row a part.
Readers map the files into memory (np.memmap; a store without local paths is
read through pyarrow's file systems).

Defined results: a null text is empty (it holds the end id alone); a null
doc_id is kept as null and comes first; equal doc_ids are ordered by a hash of the text, then the text;
other columns are ignored; an empty table gives an empty dataset.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import crc32_u32, encoder, new_path, read, texts_of, tokenizer

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
NULL_ID = np.iinfo(np.int64).min        # stands for a null doc_id in the docs file
FILES = ("tokens", "offsets", "docs")


def _fs(path: str):
    """(file system, path on it); local paths and file: URIs give None."""
    if "://" not in path and not path.startswith("file:"):
        return None, path
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_out(path: str):
    f, p = _fs(path)
    return open(p, "wb") if f is None else f.open_output_stream(p)


def make_dir(path: str) -> None:
    import os

    f, p = _fs(path)
    os.makedirs(p, exist_ok=True) if f is None else f.create_dir(p, recursive=True)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where it has a local path."""
    f, p = _fs(path)
    if f is None:
        import os

        return np.memmap(p, dtype=dtype, mode="r") if os.path.getsize(p) else np.empty(0, dtype)
    with f.open_input_file(p) as s:
        return np.frombuffer(s.read_buffer(), dtype=dtype)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str = TOKENIZER, end_id: int = END_ID) -> list[dict]:
    """Encode every document and write the dataset; returns (and stores as
    index.json) one entry a part: name, docs, tokens, base and dtype."""
    vocabulary = max(tokenizer(tokenizer_file).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    make_dir(path)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, name, out, start, n = None, "", (), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if tok is None:
                tok = encoder(tokenizer_file)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                out = [open_out(f"{path}/{name}.{x}") for x in FILES]
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8")
            starts = np.empty(len(ids), "<i8")
            for i, t in enumerate(tok.encode(b.column(1).to_pylist())):
                starts[i] = start
                out[0].write(np.append(t, end_id).astype(dtype).tobytes())
                start += len(t) + 1
            out[1].write(starts.tobytes())
            out[2].write(ids.tobytes())
            n += len(ids)
        if tok is not None:
            out[1].write(np.array([start], "<i8").tobytes())
            for x in out:
                x.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name],
                                              "docs": [n], "tokens": [start]})

    # range bounds are sampled to the driver: a text's hash stands for the text there
    rows = (texts_of(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
            .sortWithinPartitions("doc_id", "h", "text").drop("h").mapInArrow(part, "part long, name string, docs long, tokens long").collect())   # one row a part
    parts, base = [], 0
    for r in sorted(rows, key=lambda r: r["part"]):
        parts.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "base": base, "dtype": dtype})
        base += r["tokens"]
    with open_out(f"{path}/index.json") as f:
        f.write(json.dumps(parts).encode())
    return parts


def document(path: str, part: dict, i: int) -> np.ndarray:
    """The ids of document ``i`` of a part, from the mapped files."""
    o = mapped(f"{path}/{part['name']}.offsets", "<i8")
    return mapped(f"{path}/{part['name']}.tokens", part["dtype"])[o[i]:o[i + 1]]


def read_tokens(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                p = parts[k]
                tokens, offsets, ids = (mapped(f"{path}/{p['name']}.{x}", d)
                                        for x, d in zip(FILES, (p["dtype"], "<i8", "<i8")))
                for a in range(0, p["docs"], 4096):
                    z = min(a + 4096, p["docs"])
                    o = np.asarray(offsets[a:z + 1])
                    crc = [crc32_u32(tokens[s:e]) for s, e in zip(o[:-1].tolist(), o[1:].tolist())]
                    d = np.asarray(ids[a:z])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64(), mask=d == NULL_ID), pa.array(o[:-1] + p["base"], pa.int64()),
                         pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(rows, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    parts = write_tokens(read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, parts)
