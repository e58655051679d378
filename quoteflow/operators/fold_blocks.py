"""Entry states of blocks of a pair's trades, without folding the pair in one task.

A pair of more than a block of trades is cut by dense trade numbers into blocks, each a whole
number of leaves (see ``position``). Three tree reductions over its leaves give every block the state
that the fold has there:

1. *Floors.* The quantity before a leaf is at least w, the stock if every sell took what there is
   (w' = max(w - sell, 0)), and at most w + M, M the pair's largest sell: an ignored sell is larger than
   the stock, so both bounds survive every trade. w is a (net, lowest prefix) reduction.
2. *Quantities.* On [w, w + M] a leaf maps the entry quantity piecewise to a translation, a constant
   or no position. A sell of x cuts a piece where its quantity passes x: below, it is ignored, at x the
   position goes, above it is taken. While every piece holds more than x nothing is cut, so
   only sells that meet low stock cost more than an addition. Maps compose to maps of the same kind.
3. *Costs.* Given the quantities, a leaf maps the entry cost to a * c + b.

Then all blocks fold in parallel from their entry states, with the bits of one long fold. Flat
books, where nearly every leaf starts without a position, are no special case. A leaf's map has at most
three pieces more for every sell that meets low stock; a task holds one leaf's trades, or the maps of one
node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.operators.position import Position
from quoteflow.operators.running import dense_order
from quoteflow.operators.tree import entry_states
from quoteflow.session import checkpoint_dir

ORDER = ["ts", "order_id", "side", "amount", "price"]
MAPS = "pair string, item long, map binary"
#: Kinds of pieces: quantity + value, the value itself, no position.
MOVE, FIXED, NONE = range(3)


# ------------------------------------------------------------------ 1 floors
def floor_map(signed: np.ndarray) -> bytes:
    before = np.cumsum(signed)
    return np.array([before[-1], min(0, before.min())], "<i8").tobytes()


def join_floors(a: bytes, b: bytes) -> bytes:
    (n, low), (m, lower) = np.frombuffer(a, "<i8").tolist(), np.frombuffer(b, "<i8").tolist()
    return np.array([n + m, min(low, n + lower)], "<i8").tobytes()


def step_floor(m: bytes, state: bytes) -> bytes:
    (net, low), (w,) = np.frombuffer(m, "<i8").tolist(), np.frombuffer(state, "<i8").tolist()
    return np.array([max(w + net, net - low)], "<i8").tobytes()


# -------------------------------------------------------------- 2 quantities
class Pieces:
    """A leaf's quantity map on [w, w + most], built trade by trade. Piece i holds the entry
    quantities from at[i] to at[i + 1]; values are less ``off``, which all positions share."""

    def __init__(self, w: int, most: int):
        self.at = np.array([w], np.int64)
        self.kind = np.array([MOVE], np.int8)
        self.value = np.zeros(1, np.int64)
        self.end, self.off = w + most + 1, 0
        self.least = w                     # the least quantity that a position can have now
        self.gone = False                  # whether a piece is without a position
        self.none = (NONE, 0)              # the image of no position at all, which needs w = 0

    def run(self, buys, amounts) -> "Pieces":
        for buy, x in zip(buys, amounts):
            if buy:
                self.off += x
                if self.none[0] == NONE:
                    self.none = (FIXED, x)
                else:
                    self.none = (FIXED, self.none[1] + x)
                self.least += x
                if self.gone:
                    new = self.kind == NONE
                    self.kind[new] = FIXED
                    self.value[new] = x - self.off
                    self.gone, self.least = False, min(self.least, x)
            else:
                if self.none[0] == FIXED and self.none[1] >= x:
                    self.none = (FIXED, self.none[1] - x) if self.none[1] > x else (NONE, 0)
                if x < self.least:
                    self.off -= x
                    self.least -= x
                else:
                    self._sell(x)
        return self

    def _sell(self, x: int) -> None:
        shift = self.value + self.off
        cuts = x - shift[self.kind == MOVE]
        cuts = np.concatenate((cuts, cuts + 1, self.at))
        # a cut belongs to the piece that asked for it; elsewhere it parts equal halves, merged below
        at = np.unique(cuts[(cuts >= self.at[0]) & (cuts < self.end)])
        src = np.searchsorted(self.at, at, "right") - 1
        kind, shift = self.kind[src], shift[src]
        low = np.where(kind == MOVE, at + shift, shift)
        has = kind != NONE
        none = has & (low == x)
        shift = np.where(has & (low > x), shift - x, shift)
        kind, shift = np.where(none, NONE, kind).astype(np.int8), np.where(none | (kind == NONE), 0, shift)
        new = np.ones(len(at), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (shift[1:] != shift[:-1])
        self.at, self.kind, shift = at[new], kind[new], shift[new]
        self.gone = bool((self.kind == NONE).any())
        low = np.where(self.kind == MOVE, self.at + shift, shift)[self.kind != NONE]
        self.least = int(low.min()) if len(low) else 1 << 62
        self.off, self.value = 0, shift

    def encoded(self) -> bytes:
        rows = np.stack([self.at, self.kind.astype(np.int64), np.where(self.kind == NONE, 0, self.value + self.off)], 1)
        return np.concatenate(([[self.end, *self.none]], rows)).astype("<i8").tobytes()


def _decoded(m: bytes) -> np.ndarray:
    """Row 0: (end, image of no position); then (from, kind, value) of every piece."""
    return np.frombuffer(m, "<i8").reshape(-1, 3)


def _image(rows: np.ndarray, kind: int, q: int) -> tuple[int, int]:
    """Where a map takes (FIXED, quantity) or (NONE, 0)."""
    if kind == NONE:
        return int(rows[0, 1]), int(rows[0, 2])
    _, k, v = rows[np.searchsorted(rows[1:, 0], q, "right")].tolist()
    return (FIXED, q + v) if k == MOVE else (k, v)


def join_pieces(a: bytes, b: bytes) -> bytes:
    one, two = _decoded(a), _decoded(b)
    out = [(int(one[0, 0]), *_image(two, int(one[0, 1]), int(one[0, 2])))]
    ends = np.append(one[2:, 0], one[0, 0]).tolist()
    inner = two[2:, 0]
    for (start, kind, value), end in zip(one[1:].tolist(), ends):
        if kind != MOVE:
            out.append((start, *_image(two, kind, value)))
            continue
        cuts = inner[np.searchsorted(inner, start + value, "right"):np.searchsorted(inner, end + value, "left")] - value
        for c in [start, *cuts.tolist()]:
            _, k, v = two[np.searchsorted(two[1:, 0], c + value, "right")].tolist()
            out.append((c, k, v + value) if k == MOVE else (c, k, v))
    merged = out[:2]
    merged += [y for x, y in zip(out[1:], out[2:]) if x[1:] != y[1:]]
    return np.array(merged, "<i8").tobytes()


def state_bytes(has: bool, q: int) -> bytes:
    return np.array([int(has), q], "<i8").tobytes()


def step_pieces(m: bytes, state: bytes) -> bytes:
    has, q = np.frombuffer(state, "<i8").tolist()
    kind, q = _image(_decoded(m), FIXED if has else NONE, q)
    return state_bytes(kind == FIXED, q)


# ------------------------------------------------------------------- 3 costs
def join_costs(m: bytes, n: bytes) -> bytes:
    (a, b), (a1, b1) = np.frombuffer(m, "<f8").tolist(), np.frombuffer(n, "<f8").tolist()
    return np.array([a1 * a, a1 * b + b1], "<f8").tobytes()


def step_cost(m: bytes, state: bytes) -> bytes:
    (a, b), (c,) = np.frombuffer(m, "<f8").tolist(), np.frombuffer(state, "<f8").tolist()
    return np.array([a * c + b], "<f8").tobytes()


# --------------------------------------------------------------------- passes
def leaves(batches: Iterator[pd.DataFrame], leaf_rows: int) -> Iterator[tuple[str, int, pd.DataFrame]]:
    """(pair, leaf, its trades) of a partition sorted by (pair, ord); holds one leaf and one batch."""
    held, at = [], None
    for b in batches:
        if not len(b):
            continue
        leaf = b["ord"].values // leaf_rows
        pair = b["pair"].values
        cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (pair[1:] != pair[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            key = (pair[i], int(leaf[i]))
            if at is not None and key != at:
                yield *at, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            at = key
            held.append(b.iloc[i:j])
    if held:
        yield *at, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _maps(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["pair", "item", "map"])


def _grouped(found: Iterator[tuple], size: int = 512) -> Iterator[pd.DataFrame]:
    rows = []
    for r in found:
        rows.append(r)
        if len(rows) >= size:
            yield _maps(rows)
            rows = []
    if rows:
        yield _maps(rows)


def blocks_of(trades: DataFrame, block_rows: int, leaf_rows: int, fan: int) -> DataFrame:
    """``trades`` (as ``pnl.in_units`` gives them) with their number ``ord`` within the pair, block
    ``blk`` and the block's entry state q_in, has_in, c_in; partitions are whole blocks in order."""
    spark = trades.sparkSession
    checkpoint_dir(spark)
    rows = dense_order(trades, ["pair"], ORDER, "ord").withColumn("blk", F.expr(f"ord div {block_rows}"))
    rows = rows.repartition("pair", "blk").sortWithinPartitions("pair", "ord").checkpoint()   # read by four passes
    a_block = block_rows // leaf_rows

    def of_blocks(states: DataFrame) -> DataFrame:
        """States at block starts: one row for block_rows trades, which bounds the broadcast."""
        at = states.where(F.col("item") % a_block == 0)
        return F.broadcast(at.select("pair", F.expr(f"item div {a_block}").alias("blk"), "state"))

    def floors(batches):
        yield from _grouped((pair, leaf, floor_map(np.where(b["side"].values == "buy", 1, -1) * b["amount"].values))
                            for pair, leaf, b in leaves(batches, leaf_rows))

    least = entry_states(rows.mapInPandas(floors, MAPS), join_floors, step_floor, np.zeros(1, "<i8").tobytes(), fan)
    most = rows.groupBy("pair").agg(F.max(F.when(F.col("side") != "buy", F.col("amount")).otherwise(0)).alias("most"))

    def pieces(batches):
        def each():
            at, w = None, 0
            for pair, leaf, b in leaves(batches, leaf_rows):
                if at != (pair, leaf):                          # a block begins
                    w = int(np.frombuffer(b["state"].iloc[0], "<i8")[0])
                buys = b["side"].values == "buy"
                m = Pieces(w, int(b["most"].iloc[0])).run(buys.tolist(), b["amount"].tolist())
                yield pair, leaf, m.encoded()
                signed = np.where(buys, 1, -1) * b["amount"].values
                w = int(np.frombuffer(step_floor(floor_map(signed), np.array([w], "<i8").tobytes()), "<i8")[0])
                at = (pair, leaf + 1) if (leaf + 1) % a_block else None
        yield from _grouped(each())

    # one row a pair: pairs of more than a block only, so at most rows / block_rows of them
    known = rows.join(of_blocks(least), ["pair", "blk"]).join(F.broadcast(most), "pair")
    held = entry_states(known.mapInPandas(pieces, MAPS), join_pieces, step_pieces, state_bytes(False, 0), fan)

    def costs(batches):
        def each():
            at, now = None, None
            for pair, leaf, b in leaves(batches, leaf_rows):
                if at != (pair, leaf):
                    has, q = np.frombuffer(b["state"].iloc[0], "<i8").tolist()
                    now = Position(q, bool(has), leaf=1 << 62)
                now.c, now.levels = 0.0, [(0.0, 1.0, 0.0)]
                now.run(b["side"].tolist(), b["amount"].tolist(), b["price"].tolist())
                yield pair, leaf, np.array(now.map(), "<f8").tobytes()
                at = (pair, leaf + 1) if (leaf + 1) % a_block else None
        yield from _grouped(each())

    costly = entry_states(rows.join(of_blocks(held), ["pair", "blk"]).mapInPandas(costs, MAPS),
                          join_costs, step_cost, np.zeros(1, "<f8").tobytes(), fan)
    entry = of_blocks(held).withColumnRenamed("state", "position").join(of_blocks(costly), ["pair", "blk"])
    return rows.join(F.broadcast(entry), ["pair", "blk"])
