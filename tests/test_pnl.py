"""P&L fold, thresholds and annualized return: hand cases and a restatement."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest

from quoteflow.operators import pnl


def trades(spark, rows):
    """rows: (pair, side, amount, price); ts increases with the row index."""
    base = dt.datetime(2024, 1, 1)
    data = [(p, f"o{i:05d}", s, float(a), float(pr), base + dt.timedelta(minutes=i))
            for i, (p, s, a, pr) in enumerate(rows)]
    return spark.createDataFrame(data, "pair string, order_id string, side string, amount double, "
                                       "price double, ts timestamp_ntz")


def by_pair(df):
    return {r.pair: r for r in pnl.pnl_by_pair(pnl.fold_trades(df)).collect()}


def test_weighted_average_cost_case(spark):
    rows = [("A", "buy", 10, 2), ("A", "buy", 10, 4), ("A", "sell", 5, 6), ("A", "sell", 99, 6),
            ("A", "sell", 15, 3), ("A", "sell", 1, 7), ("B", "sell", 2, 5)]
    r = by_pair(trades(spark, rows))
    assert r["A"].realized_pnl == Decimal("22.000000")
    assert r["B"].realized_pnl == Decimal("10.000000")
    assert not r["A"].has_position and not r["B"].has_position


def test_zero_buy_keeps_a_position_so_sell_is_ignored(spark):
    # Q13: a 0-amount buy creates a zero position; the sell is then "short" (ignored).
    r = by_pair(trades(spark, [("A", "buy", 0, 3), ("A", "sell", 2, 5)]))
    assert r["A"].realized_pnl == Decimal("0.000000") and r["A"].has_position


def test_fractional_quantities_are_exact(spark):
    # 0.1 + 0.2 - 0.3 leaves no position, so the next sell is all profit.
    r = by_pair(trades(spark, [("A", "buy", 0.1, 2), ("A", "buy", 0.2, 2), ("A", "sell", 0.3, 2), ("A", "sell", 1, 7),
                               ("B", "buy", 0.7, 1), ("B", "buy", 0.1, 1), ("B", "sell", 0.8, 2)]))
    assert r["A"].realized_pnl == Decimal("7.000000") and not r["A"].has_position
    assert r["B"].realized_pnl == Decimal("0.800000") and not r["B"].has_position


def test_fold_in_tenths_matches_exact_fractions(spark):
    from fractions import Fraction

    rnd = random.Random(9)
    rows = [(f"P{rnd.randrange(6)}", rnd.choice(["buy", "sell"]), rnd.randrange(0, 40) / 10, rnd.randrange(1, 500))
            for _ in range(3000)]
    inv, total = {}, {}
    for p, s, a, pr in rows:
        a, d = Fraction(str(a)), Fraction(0)
        if s == "buy":
            q, c = inv.get(p, (Fraction(0), Fraction(0)))
            inv[p] = (q + a, (q * c + a * pr) / (q + a) if q + a else Fraction(0))
        elif p not in inv:
            d = a * pr
        elif inv[p][0] >= a:
            q, c = inv.pop(p)
            d = (pr - c) * a
            if q > a:
                inv[p] = (q - a, c)
        total[p] = total.get(p, 0) + d
    got = by_pair(trades(spark, rows))
    for p, want in total.items():
        assert float(got[p].realized_pnl) == pytest.approx(float(want), abs=1e-3)
        assert got[p].has_position == (p in inv) and got[p].quantity == float(inv.get(p, (0, 0))[0])


def _restate(rows):
    inv, total = {}, {}
    for p, s, a, pr in rows:
        a, pr = float(a), float(pr)
        d = 0.0
        if s == "buy":
            q, c = inv.get(p, (0.0, 0.0))
            nq = q + a
            inv[p] = (nq, (q * c + a * pr) / nq if nq > 0 else 0.0)
        elif p in inv and inv[p][0] >= a:
            q, c = inv[p]
            d = (pr - c) * a
            if q - a > 0:
                inv[p] = (q - a, c)
            else:
                del inv[p]
        elif p not in inv:
            d = pr * a
        total[p] = total.get(p, Decimal(0)) + Decimal(d).quantize(Decimal("0.000001"))
    return total


def test_fold_matches_restatement_on_random_trades(spark):
    rnd = random.Random(7)
    rows = [(f"P{rnd.randrange(6)}", rnd.choice(["buy", "buy", "sell"]), rnd.randrange(0, 20),
             rnd.randrange(1, 500) / 4) for _ in range(3000)]
    got = {p: r.realized_pnl for p, r in by_pair(trades(spark, rows)).items()}
    want = _restate(rows)
    assert set(got) == set(want)
    for p in want:
        assert abs(got[p] - want[p]) <= Decimal("0.000002") * max(1, len(rows))


def test_cumulative_pnl_is_a_global_running_sum(spark):
    rows = [("A", "sell", 1, 5), ("B", "sell", 2, 5), ("A", "sell", 1, 1)] * 40
    f = pnl.fold_trades(trades(spark, rows))
    cum = pnl.cumulative_pnl(f).orderBy("ts", "order_id").collect()
    run, want = Decimal(0), []
    for r in cum:
        run += r.pnl
        want.append(run)
    assert [r.cum_pnl for r in cum] == want


def test_threshold_commands_and_alerts(spark):
    rows = [("A", "sell", 1, 500), ("A", "sell", 1, 1000), ("A", "sell", 1, 10)]
    f = pnl.fold_trades(trades(spark, rows))
    cum = pnl.cumulative_pnl(f)
    base = dt.datetime(2024, 1, 1)
    cmds = spark.createDataFrame(
        [(1, base - dt.timedelta(minutes=1), Decimal("-1000")),
         (2, base - dt.timedelta(minutes=1), Decimal("1000")),
         (3, base + dt.timedelta(minutes=2), Decimal("1600")),
         (4, base + dt.timedelta(minutes=3), Decimal("0"))],
        "command_id long, ts timestamp_ntz, threshold decimal(18,2)")
    got = {r.command_id: r for r in pnl.threshold_alerts(cum, cmds).collect()}
    assert got[1].status == "error: Threshold must be non-negative" and got[1].alert_ts is None
    # 500 then 1500: reached at the second trade
    assert got[2].status == "set" and got[2].alert_order_id == "o00001"
    assert got[2].alert_cum_pnl == Decimal("1500.000000")
    # 1510 after the third trade: 1600 is never reached
    assert got[3].alert_ts is None
    assert got[4].status == "cleared"


def test_annualized_return_validation_and_value(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, 4.0, 5.0, d, d + dt.timedelta(days=730)),     # ok
            (2, -6.0, 5.0, d, d + dt.timedelta(days=10)),     # investment
            (3, 4.0, -6.0, d, d + dt.timedelta(days=10)),     # P&L first
            (4, 4.0, 5.0, d + dt.timedelta(days=1), d),       # duration
            (5, None, 4.0, None, d), (6, 4.0, 5.0, None, d),  # investment before start
            (7, 5.0, None, d, d + dt.timedelta(days=365)), (8, 4.0, 5.0, d, None)]
    df = spark.createDataFrame(rows, "portfolio_id long, init_invest double, cum_pnl double, "
                                     "start_date date, end_date date")
    got = {r.portfolio_id: r for r in pnl.annualized_return(df).collect()}
    assert got[1].error is None
    assert got[1].annualized_return == pytest.approx((5 / 4) ** (1 / 2.0) - 1, abs=1e-9)
    assert got[2].error == "Initial investment should be larger than 0"
    assert got[3].error == "PNL should be non-negative"
    assert got[4].error == got[8].error == "Duration of Year should be larger than 0"
    assert got[5].error == "Initial investment amount not set" and got[6].error == "Trading has not been started yet"
    assert (got[7].cum_pnl, got[7].error, got[7].annualized_return) == (0, None, -1)


def test_empty_inputs(spark):
    empty = trades(spark, [])
    f = pnl.fold_trades(empty)
    assert f.count() == 0
    assert pnl.total_pnl(f).first().total_pnl == Decimal("0.000000")
    cum = pnl.cumulative_pnl(f)
    assert cum.count() == 0
    cmds = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), Decimal("5"))],
                                 "command_id long, ts timestamp_ntz, threshold decimal(18,2)")
    a = pnl.threshold_alerts(cum, cmds).collect()
    assert len(a) == 1 and a[0].alert_ts is None
    s = pnl.pnl_status(cum, pnl.threshold_alerts(cum, cmds)).first()
    assert s.current_pnl == 0 and s.threshold == Decimal("5.00") and s.threshold_reached is False
    s = pnl.pnl_status(cum, pnl.threshold_alerts(cum, cmds.where("false"))).first()
    assert (s.current_pnl, s.threshold, s.threshold_reached, s.trading_active) == (0, None, False, True)


def test_first_index_search_equals_brute_force():
    from quoteflow.operators.first_reach import first_at_least
    rnd = random.Random(3)
    for n in (1, 2, 3, 8, 61, 300):
        v = np.array([rnd.randrange(-50, 50) for _ in range(n)], np.int64)
        starts = np.array([rnd.randrange(0, n + 2) for _ in range(400)])
        least = np.array([rnd.randrange(-60, 60) for _ in range(400)], np.int64)
        want = [next((i for i in range(s, n) if v[i] >= h), n) for s, h in zip(starts, least)]
        assert first_at_least(v, starts, least).tolist() == want
    assert first_at_least(v, starts[:0], least[:0]).tolist() == []


@pytest.mark.parametrize("share", [100_000, 3])
def test_alerts_equal_a_plain_scan(spark, monkeypatch, share):
    """Many trades a day, commands before, between and after them, values beyond a long's millionths."""
    from quoteflow.operators import first_reach
    monkeypatch.setattr(first_reach, "COMMANDS_A_TASK", share)
    rnd = random.Random(17)
    base = dt.datetime(2024, 1, 1)
    cum, rows = Decimal("98765432109876.5"), []
    for i in range(3000):
        cum += Decimal(rnd.randrange(-1000, 1010)) / 4
        rows.append((base + dt.timedelta(minutes=(i // 7) * 11 % 40000 if i < 2500 else 27000 + i), f"o{i:05d}", cum))
    rows.sort(key=lambda r: r[:2])
    near = [r[2] for r in rows]
    cmds = []
    for c in range(300):
        ts = base + dt.timedelta(minutes=rnd.randrange(-2000, 32000))
        then = next((v for t, _, v in rows if t >= ts), near[-1])
        cmds.append((c, ts, rnd.choice([Decimal(0), Decimal(-1), rnd.choice(near), max(near), max(near) + 1]
                                       + [then + rnd.randrange(-100, 600) for _ in range(8)])))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, order_id string, cum_pnl decimal(38,6)")
    got = {r.command_id: r for r in pnl.threshold_alerts(df, spark.createDataFrame(
        cmds, "command_id long, ts timestamp_ntz, threshold decimal(38,6)")).collect()}
    eff = {}
    for c, ts, thr in cmds:
        if thr >= 0:
            eff[ts] = max(eff.get(ts, (-1, 0)), (c, thr))
    times, hits = sorted(eff), 0
    want = {}
    for ts, end in zip(times, [*times[1:], None]):
        c, thr = eff[ts]
        if thr > 0:
            want[c] = next(((t, o, v) for t, o, v in rows if t >= ts and (end is None or t < end) and v >= thr), None)
    assert len(got) == len(cmds)
    for c, r in got.items():
        hit = want.get(c)
        hits += hit is not None
        assert (r.alert_ts, r.alert_order_id, r.alert_cum_pnl) == (hit or (None, None, None)), c
    assert hits > 20
