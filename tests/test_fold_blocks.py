"""One fold path: blocks, leaves and their entry states against plain loops."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest

from quoteflow.operators import fold_blocks as fb
from quoteflow.operators import pnl
from quoteflow.operators.position import Position

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "pair string, order_id string, side string, amount double, price double, ts timestamp_ntz"


def trades(spark, n, pairs, seed, sell_share=0.4, steps=10):
    rnd = random.Random(seed)
    data = [(f"P{rnd.randrange(pairs)}", f"o{i:06d}", "sell" if rnd.random() < sell_share else "buy",
             rnd.randrange(0, 12 * steps) / steps, rnd.randrange(1, 400) / 4, BASE + dt.timedelta(seconds=i // 3))
            for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def by_order(df):
    return {r.order_id: r for r in df.collect()}


def quantities(rows, q=0, has=False):
    """The quantity path by the rules: the state before every trade and at the end."""
    out = [(has, q)]
    for buy, x in rows:
        if buy:
            q, has = q + x, True
        elif has and q >= x:
            q -= x
            has, q = (True, q) if q > 0 else (False, 0)
        out.append((has, q))
    return out


def random_rows(r, n, most, share):
    return [(r.random() < share, r.choice([0, 1, 5, r.randrange(most), r.randrange(most)])) for _ in range(n)]


@pytest.mark.parametrize("most,share", [(6, 0.5), (40, 0.5), (1000, 0.45), (10**6, 0.55), (40, 0.2), (40, 0.8)])
def test_pieces_map_every_entry_quantity(most, share):
    r = random.Random(most)
    for _ in range(60):
        rows = random_rows(r, r.randrange(1, 60), most, share)
        w, top = r.randrange(0, 2 * most), max([x for buy, x in rows if not buy], default=0)
        m = fb.Pieces(w, top).run(*map(list, zip(*rows))).encoded()
        for q in {w, w + top, *[w + r.randrange(top + 1) for _ in range(40)]}:
            has, end = np.frombuffer(fb.step_pieces(m, fb.state_bytes(True, q)), "<i8").tolist()
            assert (bool(has), end) == quantities(rows, q, True)[-1]
        has, end = np.frombuffer(fb.step_pieces(m, fb.state_bytes(False, 0)), "<i8").tolist()
        assert (bool(has), end) == quantities(rows)[-1]


def test_joined_maps_and_floors_follow_the_path():
    r = random.Random(8)
    for k in range(150):
        rows = random_rows(r, 160, r.choice([6, 50, 5000]), r.choice([0.4, 0.5, 0.6]))
        top = max(x for buy, x in rows if not buy)
        path = quantities(rows)
        maps, floors, w = [], [], 0
        for i in range(0, 160, 16):
            part = rows[i:i + 16]
            assert w <= path[i][1] <= w + top                     # the window that a leaf's map covers
            maps.append(fb.Pieces(w, top).run(*map(list, zip(*part))).encoded())
            floors.append(fb.floor_map(np.array([x if buy else -x for buy, x in part])))
            w = int(np.frombuffer(fb.step_floor(floors[-1], np.array([w], "<i8").tobytes()), "<i8")[0])
        whole, floor = maps[0], floors[0]
        for m, f in zip(maps[1:], floors[1:]):
            whole, floor = fb.join_pieces(whole, m), fb.join_floors(floor, f)
        has, q = np.frombuffer(fb.step_pieces(whole, fb.state_bytes(False, 0)), "<i8").tolist()
        assert (bool(has), q) == path[-1]
        assert int(np.frombuffer(fb.step_floor(floor, np.zeros(1, "<i8").tobytes()), "<i8")[0]) == w


@pytest.mark.parametrize("sell_share", [0.3, 0.5, 0.65])
def test_same_bits_at_every_block_size(spark, sell_share):
    t = trades(spark, 6000, 3, seed=11, sell_share=sell_share).cache()
    cols = ["order_id", "delta", "quantity", "avg_cost", "has_position"]
    want = None
    for block in (128, 32, 8):                                    # 128 = a node: 16 leaves of 8
        got = sorted(map(tuple, pnl.fold_trades(t, block, 8, 16).select(*cols).collect()))
        assert want is None or got == want
        want = got
    # the rounding is that of Position from the first trade on, to the last bit
    loop = {}
    for r in sorted(t.collect(), key=lambda r: (r.ts, r.order_id, r.side, r.amount, r.price)):
        p = loop.setdefault(r.pair, (Position(leaf=8, fan=16), []))
        d, q, c, h = p[0].run([r.side], [round(r.amount * 10**8)], [r.price])
        p[1].append((r.order_id, d[0], q[0], c[0], h[0]))
    assert sorted(x for _, rows in loop.values() for x in rows) == want
    # and close to a plain fold
    plain = by_order(pnl.fold_trades(t))
    for o, d, q, c, h in want:
        assert (plain[o].quantity, plain[o].has_position) == (q, h)
        assert plain[o].delta == pytest.approx(d, rel=1e-9, abs=1e-6) and plain[o].avg_cost == pytest.approx(c, rel=1e-9, abs=1e-9)


def test_leaves_change_only_the_last_bits():
    r = random.Random(4)
    sides = [r.choice(["buy", "buy", "sell"]) for _ in range(5000)]
    amounts, prices = [r.randrange(1, 10**10) for _ in sides], [r.randrange(1, 10**6) / 128 for _ in sides]
    plain = Position(leaf=1 << 40).run(sides, amounts, prices)
    for leaf, fan in ((7, 4), (64, 8), (4096, 256)):
        whole = Position(leaf=leaf, fan=fan).run(sides, amounts, prices)
        assert whole[1] == plain[1] and whole[3] == plain[3]
        assert whole[2] == pytest.approx(plain[2], rel=1e-12)
        parts, p, i = ([], [], [], []), Position(leaf=leaf, fan=fan), 0
        while i < len(sides):                                     # the same trades in pieces of any size
            j = i + r.randrange(1, 400)
            for acc, x in zip(parts, p.run(sides[i:j], amounts[i:j], prices[i:j])):
                acc.extend(x)
            i = j
            p = Position(p.q, p.has, p.c, p.n, [tuple(x) for x in p.levels], leaf, fan)      # as stored and read again
        assert parts == whole
    first = Position().run(sides[:4096], amounts[:4096], prices[:4096])
    assert first[2] == plain[2][:4096]


def test_flat_book_in_many_blocks(spark):
    """Buy 5, sell 5: 200 blocks, none of which begins with stock; a task folds a block, not the pair."""
    n = 200 * 32
    rows = [("P", f"o{i:06d}", "sell" if i % 2 else "buy", 5.0, 100.0 + i % 7, BASE + dt.timedelta(seconds=i)) for i in range(n)]
    t = spark.createDataFrame(rows, SCHEMA)
    cut = fb.blocks_of(pnl.in_units(t), 32, 8, 16)
    assert {(r["blk"], r["n"]) for r in cut.groupBy("blk").count().withColumnRenamed("count", "n").collect()} == {(i, 32) for i in range(200)}
    got = pnl.fold_trades(t, 32, 8, 16)
    assert got.selectExpr("sum(pnl) AS s").first()["s"] == sum((100 + (2 * i + 1) % 7 - 100 - 2 * i % 7) * 5 for i in range(n // 2))
    assert got.where("side = 'sell' AND (has_position OR quantity <> 0 OR avg_cost <> 0)").count() == 0


def test_block_path_against_sql(spark, tmp_path):
    """The rounding by leaves restated in SQL, on the driver's trades with short leaves."""
    from conftest import SF_SMALL
    from quoteflow.plans import oracle
    from quoteflow.sources import adapters

    t = pnl.order_to_trade(pnl.completed_orders(adapters.orders(spark, SF_SMALL)))
    got = sorted(map(tuple, pnl.pnl_by_pair(pnl.fold_trades(t, 16, 4, 8)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF_SMALL}/lineitem.parquet'")
    sql = ("WITH RECURSIVE " + oracle.ORDERS + "," + oracle.fold_sql("live", "status IN ('FullyFilled', 'PartiallyFulfilled')", 4, 8)
           + "," + oracle.PAIR_PNL + " SELECT * FROM pair_pnl")
    assert sorted(con.execute(sql).fetchall()) == got and len(got) > 100


def test_block_size_is_checked(spark):
    for block, leaf, fan in ((12, 4, 8), (64, 4, 8), (10, 4, 8), (24, 4, 6)):
        with pytest.raises(ValueError):
            pnl.fold_trades(trades(spark, 3, 1, 1), block, leaf, fan)
