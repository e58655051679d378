"""Operator 4: exact dedup with Patricia-trie owners.

Every scan partition inserts the whole texts (UTF-8 bytes) it reads into a
compressed radix trie, whose terminal nodes store the owner (the largest document id;
``keep="min"`` stores the smallest), a count and a number; each document leaves with its
terminal's number. So a group of copies leaves a partition as one text, however large
it is. When the trie holds more than ``spill`` bytes, its largest subtrees are spilled
(their terminals go out); a text that comes again then gets another terminal.

The terminals are dealt by length and the first bits of the content hash to owner
partitions and sorted by their bytes. An owner partition inserts them into one trie; a
subtree that lies before the newest text is finished, and is spilled when the trie
holds more than ``spill`` bytes. Equal texts meet in one terminal there: the trie decides
what is equal, the hash only deals. An owner row goes out for every number of a group.

Documents take their group's owner by a join on the number; groups of one need none.

Defined results: a null text is an empty one; null doc_ids rank below all others;
of rows repeated with the same doc_id and text one is kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import read, stage, texts_of

SPILL_BYTES = 64 << 20
ROWS_OUT = 2048
#: Hexadecimal digits of the content hash that deal texts of one length.
HASH_DIGITS = 3
SCAN = "doc_id long, row long, term long, sha string, body binary, copies long"
OWNERS = "term long, keep_id long, keep_row long, copies long"


class Patricia:
    """A compressed radix trie over byte strings. A node is [children, value];
    children: first byte of the label -> (label, node)."""

    def __init__(self):
        self.root = [{}, None]

    def insert(self, key: bytes) -> list:
        """The terminal node of ``key``; its value is None when it is new."""
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                new = [{}, None]
                node[0][key[at]] = (key[at:], new)
                return new
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = self.shared(label, key, at)
            middle = [{label[k]: (label[k:], child)}, None]
            node[0][label[0]] = (label[:k], middle)
            node, at = middle, at + k
        return node

    @staticmethod
    def shared(label: bytes, key: bytes, at: int) -> int:
        """Length of the common prefix, by halving."""
        a, z = 0, min(len(label), len(key) - at)
        while a < z:
            m = (a + z + 1) // 2
            if label[a:m] == key[at + a:at + m]:
                a = m
            else:
                z = m - 1
        return a

    def terminals(self, prefix: bytes = b"", node: list | None = None) -> Iterator[tuple[bytes, object]]:
        """Texts and values at and below a node, the root by default."""
        todo = [(prefix, node or self.root)]
        while todo:
            prefix, (children, value) = todo.pop()
            if value is not None:
                yield prefix, value
            todo += [(prefix + label, child) for label, child in children.values()]

    def cut(self, first: int) -> Iterator[tuple[bytes, object]]:
        """Spill the subtree of the texts that begin with this byte."""
        label, child = self.root[0].pop(first)
        return self.terminals(label, child)

    def before(self, last: bytes) -> Iterator[tuple[bytes, object]]:
        """Spill all subtrees, and texts on the path, before the text ``last`` that was
        inserted last; in sorted order no more of them come."""
        node, at = self.root, 0
        while at < len(last):
            if node[1] is not None:
                yield last[:at], node[1]
                node[1] = None
            for first in [x for x in node[0] if x != last[at]]:
                label, child = node[0].pop(first)
                yield from self.terminals(last[:at] + label, child)
            label, node = node[0][last[at]]
            at += len(label)


def _mine(doc_id, row: int) -> tuple:
    """What owners are compared by: (has an id, id, row)."""
    return doc_id is not None, doc_id if doc_id is not None else 0, row


def _key(r: tuple) -> tuple:
    """For the smallest id: ids before none."""
    return (not r[0], r[1], r[2])


def _best(keep: str):
    return max if keep == "max" else lambda a, b: min(a, b, key=_key)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)],
                                      names=[name for name, _ in fields])


def _batches(rows: Iterator[tuple], schema: str, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS_OUT rows, and about ``size`` bytes of texts."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[4]) if schema is SCAN else 0
        if len(out) >= ROWS_OUT or held > size:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def scanned(docs: DataFrame, best, spill: int = SPILL_BYTES) -> DataFrame:
    """A row per document (copies null) and a row per terminal (body, copies), of every scan partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = term = TaskContext.get().partitionId() << 33
        trie, held, total = Patricia(), Counter(), 0        # bytes held by first byte

        def rows(terminals):
            for body, ((has, doc_id, r), copies, number, sha) in terminals:
                yield doc_id if has else None, r, number, sha, body, copies

        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                body = text.as_buffer().to_pybytes()
                node = trie.insert(body)
                if node[1] is None:
                    node[1] = [_mine(doc_id, row), 0, term, hashlib.sha256(body).hexdigest()]
                    term += 1
                    held[body[0] if body else -1] += len(body) + 400
                    total += len(body) + 400
                v = node[1]
                v[0], v[1] = best(v[0], _mine(doc_id, row)), v[1] + 1
                out.append((doc_id, row, v[2], v[3], None, None))
                row += 1
                if total > spill:
                    for first, size in held.most_common():
                        if first >= 0 and total > spill // 2:
                            yield from _batches(rows(trie.cut(first)), SCAN)
                            total -= held.pop(first)
            if out:
                yield _batch(out, SCAN)
        yield from _batches(rows(trie.terminals()), SCAN)

    return texts_of(docs).mapInArrow(scan, SCAN)


def owned(terminals: DataFrame, best, spill: int = SPILL_BYTES) -> DataFrame:
    """term, keep_id, keep_row and copies of every terminal whose text has copies. ``terminals``: those of ``scanned``."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = Patricia(), 0

        def rows(found):
            for _, ((has, doc_id, r), copies, numbers) in found:
                if copies > 1:
                    for n in numbers:
                        yield n, doc_id if has else None, r, copies

        for b in batches:
            c = [b.column(i).to_pylist() for i in (0, 1, 2, 5)]
            for doc_id, row, term, copies, text in zip(*c, b.column(4)):
                body = text.as_buffer().to_pybytes()
                node, mine = trie.insert(body), _mine(doc_id, row)
                if node[1] is None:
                    node[1] = [mine, 0, array("q")]
                    held += len(body) + 400
                v = node[1]
                v[0], v[1] = best(v[0], mine), v[1] + copies
                v[2].append(term)
                if held > spill:
                    yield from _batches(rows(trie.before(body)), OWNERS)
                    held = len(body) + 400
        yield from _batches(rows(trie.terminals()), OWNERS)

    dealt = terminals.repartition(F.length("body"), F.substring("sha", 1, HASH_DIGITS)).sortWithinPartitions("body")
    return dealt.mapInArrow(own, OWNERS)


def owners(docs: DataFrame, keep: str = "max", spill: int = SPILL_BYTES) -> DataFrame:
    """One row per document: doc_id, row (a unique number), keep_id, group_size,
    kept and text_sha256."""
    seen = stage(scanned(docs, _best(keep), spill), "exact-scan")
    groups = stage(owned(seen.where("copies is not null"), _best(keep), spill), "exact-owners")
    alone = F.col("copies").isNull()
    return (seen.where("copies is null").select("doc_id", "row", "term", "sha").join(groups, "term", "left")
            .select("doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
                    (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(read(spark, sf_dir, "documents")).drop("row")


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
             max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
