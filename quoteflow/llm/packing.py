"""Operator 2: sum-of-squares packing of documents into token windows.

Each scan partition packs its own documents in one pass without a shuffle. A
document's ids (and its end id) fill whole windows first; the rest, shorter
than a window, goes online to the fill level that keeps the sum of squared
counts of partially filled windows smallest. ``levels[h]`` counts the open
windows holding h tokens; for a piece of s tokens the change of the sum is
2(levels[h+s] - levels[h]) + 2 when a window of level h takes it and stays
open, 1 - 2 levels[h] when that window becomes full, and 2 levels[s] + 1 for a
new window. Ties take the fullest window. When the partition ends, open windows
are closed with little padding: the emptiest are cut up to fill the gaps of 16
tokens or more in the fullest, so at most one window a partition is left short
by more.

Memory is one batch and the open windows' members. The packed pieces are
written once; windows then get global ids from a prefix sum over the
partitions' window counts (one row a partition reaches the driver).

Defined results: null text is empty (the end id alone); null doc_ids are kept;
repeated rows are packed each; other columns are ignored; an empty table gives
no pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm.common import crc32_u32, encoder, read, stage, texts_of

TOKENIZER, END_ID, WINDOW = "word_bpe_49k.json", 1, 2048


class SumOfSquares:
    """The level array and the open windows of one partition."""

    def __init__(self, size: int):
        self.size, self.n = size, 0
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)     # level -> windows, lists of members

    def number(self) -> int:
        """Windows are numbered as they are closed, without gaps."""
        self.n += 1
        return self.n - 1

    def level_for(self, s: int) -> int:
        """The level whose window takes s tokens; 0: a new window."""
        c, v = self.size, self.levels
        best, at = 2 * int(v[s]) + 1, 0
        h = np.flatnonzero(v[1:c - s + 1]) + 1
        if len(h):
            to = h + s
            cost = np.where(to == c, 1 - 2 * v[h], 2 * (v[to] - v[h]) + 2)
            k = len(h) - 1 - int(np.argmin(cost[::-1]))          # ties: the fullest
            if cost[k] <= best:
                at = int(h[k])
        return at

    def place(self, s: int, member) -> list | None:
        """Put a piece of s < size tokens; returns the window if it is now full."""
        h = self.level_for(s)
        w = self.open[h].pop() if h else []
        if h:
            self.levels[h] -= 1
        w.append((h, s, member, 0))
        if h + s == self.size:
            return w
        self.open[h + s].append(w)
        self.levels[h + s] += 1
        return None

    def close(self, least: int = 16) -> list[list]:
        """Windows still open; gaps of ``least`` tokens or more are filled by
        cutting up the emptiest windows. Members are (offset, length, member,
        from): from counts the ids that earlier cuts of the piece took."""
        ws = [[h, w] for h in sorted(self.open, reverse=True) for w in self.open[h]]
        done, spare, i = [], [], 0
        while i < len(ws) or spare:
            h, w = ws[i] if i < len(ws) else [0, []]
            i += 1
            while self.size - h >= least or not w:
                if not spare:
                    if i >= len(ws):
                        break
                    spare = sorted(ws.pop()[1], key=lambda m: m[1])
                _, s, m, f = spare.pop()
                take = min(s, self.size - h)
                w.append((h, take, m, f))
                h += take
                if take < s:
                    spare.append((0, s - take, m, f + take))
            done.append(w)
        self.open.clear()
        self.levels[:] = 0
        return done


def pack(docs: DataFrame, tokenizer_file: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW,
         keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids_crc32 and, with keep_ids, the ids themselves (array<int>)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, tok, ss = TaskContext.get().partitionId(), None, SumOfSquares(window)
        cols = ("doc_id", "start", "length", "doc_tokens", "seq", "offset", "ids_crc32") + ("ids",) * keep_ids
        out: dict[str, list] = {c: [] for c in cols}

        def emit(seq, offset, ids, doc_id, start, total):
            row = (doc_id, start, len(ids), total, seq, offset, crc32_u32(ids)) + ((ids.tolist(),) if keep_ids else ())
            for c, v in zip(cols, row):
                out[c].append(v)

        def flush():
            b = pa.RecordBatch.from_arrays(
                [pa.array([pid] * len(out["seq"]), pa.int64())]
                + [pa.array(out[c], pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in cols],
                names=["part", *cols])
            for c in cols:
                out[c].clear()
            return b

        for b in batches:
            tok = tok or encoder(tokenizer_file)
            for doc_id, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                total = len(ids)
                whole = total - total % window
                for a in range(0, whole, window):
                    emit(ss.number(), 0, ids[a:a + window], doc_id, a, total)
                if whole < total:
                    full = ss.place(total - whole, (doc_id, whole, total, ids[whole:].copy()))
                    if full:
                        seq = ss.number()
                        for o, s, (d, st, n, x), _ in full:
                            emit(seq, o, x, d, st, n)
                if len(out["seq"]) >= 4096:
                    yield flush()
        for members in ss.close():
            seq = ss.number()
            for o, s, (d, st, n, x), f in members:
                emit(seq, o, x[f:f + s], d, st + f, n)
        if out["seq"]:
            yield flush()

    kinds = ("part long, doc_id long, start long, length long, doc_tokens long, seq long, offset long, ids_crc32 long"
             + ", ids array<int>" * keep_ids)
    packed = stage(texts_of(docs).mapInArrow(part, kinds), "packed")
    counts = {r["part"]: r["n"] for r in packed.groupBy("part").agg((F.max("seq") + 1).alias("n")).collect()}
    base, bases = 0, []
    for p in sorted(counts):                       # prefix sum, one row a scan partition
        bases.append((p, base))
        base += counts[p]
    at = docs.sparkSession.createDataFrame(bases, "part long, base long")
    return packed.join(F.broadcast(at), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("seq")).alias("sequence_id"),
        "offset", *["ids"] * keep_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), keep_ids=False)
