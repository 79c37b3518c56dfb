import math

import numpy as np
import pytest

import tidewater as tw
from tidewater.operators import backtest as bt

NAN = float("nan")


def test_price_target():
    k = bt.PriceTarget(0.0, 0.0, -math.inf, math.inf, 1.0, 0.0)
    assert [k.step(s, p)[0] for s, p in ((1, 100), (1, 101), (0, 102))] == [0, 1, 2]
    k = bt.PriceTarget(0.02, 0.001, -1, 1, 2.0, 0.5)
    equity, pnl, position, cost = k.step(5, 100)
    assert position == 1 and cost == pytest.approx(1 * 1 * 2 + 0.5 + 101 * 2 * 0.001) and equity == pnl == -cost


def test_bar_orders():
    k = bt.OhlcOrders(maker_fee=0.01)
    assert k.step(99, 2, NAN, 0, 100, 101, 99, 100) == pytest.approx((2 - 2 * 99 * 0.01, 2 - 2 * 99 * 0.01, 2, -2 + 2 * 99 * 0.01))
    assert bt.OhlcOrders(fill="breach").step(99, 2, NAN, 0, 100, 101, 99, 100)[2] == 0
    taker = bt.OhlcOrders(taker_fee=0.01, tick_size=0.5, max_position=3)
    assert taker.step(bt.MARKET, 5, 0, 0, 100, 101, 99, 100)[2:] == (3, pytest.approx(3 * 0.5 + 3 * 100.5 * 0.01))
    assert taker.step(0, 0, NAN, 1, 100, 101, 99, 100)[2] == 2  # a missing price is a market order


def test_bar_target_waits_for_the_next_open():
    k = bt.OhlcTarget(taker_fee=0.0, tick_size=0.0, min_position=-9, max_position=9, multiplier=1.0, fee_per_contract=0.0)
    assert k.step(2, 100, 101, 99, 100)[2] == 0
    assert k.step(2, 101, 103, 100, 102) == (2, 2, 2, -2)


def test_prints():
    k = bt.TradesOrders(participation_ratio=0.5)
    assert k.step(100, 10, NAN, 0, 100, 4)[2] == 2  # at the limit: a share of the print
    assert k.step(100, 10, NAN, 0, 99, 1)[2] == 12  # through it: all


def test_book():
    k = bt.L1Orders(taker_fee=0.0, tick_size=1.0)
    # at once through the ask: takes what is shown, the rest a tick worse
    equity, _, position, cost = k.step(101, 3, NAN, NAN, 99, 100, 5, 2)
    assert position == 3 and cost == pytest.approx(3 * ((2 * 100 + 101) / 3 - 99.5))
    rest = bt.L1Orders()
    assert rest.step(99, 1, NAN, NAN, 98, 100, 5, 5)[2] == 0
    assert rest.step(99, 1, NAN, NAN, 97, 98.5, 5, 5)[2:] == (1, pytest.approx(99 - 97.75))  # was resting: maker at its price
    lock = bt.L1Orders(fill="touch", participation_ratio=0.5)
    assert [lock.step(99, 9, NAN, NAN, 98, 99, 5, 4)[2] for _ in range(2)] == [2, 2]


def test_book_and_tape():
    k = bt.L1TradesOrders()
    assert k.step(99, 2, NAN, NAN, 98, 100, 5, 5, NAN, NAN)[2] == 0
    assert k.step(99, 2, NAN, NAN, 98, 100, 5, 5, 98.5, 1)[2] == 2
    run = bt.L1TradesOrders()
    run.step(99, 2, NAN, NAN, 98, 100, 5, 5, NAN, NAN)
    assert run.step(99, 2, NAN, NAN, 97, 98, 5, 5, NAN, NAN)[2] == 2  # run over


def test_engines_check_parameters():
    for kw in ({"fill": "maybe"}, {"participation_ratio": 0}, {"min_position": 2, "max_position": 1}, {"multiplier": 0}, {"tick_size": -1}):
        with pytest.raises(ValueError):
            bt.OhlcOrders(**kw)


def test_reports(spark):
    rng = np.random.default_rng(2)
    rows = [(a, i, float(rng.normal()), float(rng.integers(-1, 2)), 0.1) for a in ("x", "y") for i in range(30)]
    df = spark.createDataFrame(rows, "asset string, i int, pnl double, position double, cost double").selectExpr("*", "sum(pnl) over (partition by asset order by i) as equity")
    running, summary = tw.backtest_report(tw.series(df, "asset", "i"))
    last = {r.asset: r for r in running.df.where("i = 29").collect()}
    got = {r.asset: r for r in summary.collect()}
    for a in "xy":
        p = np.array([r[2] for r in rows if r[0] == a])
        pos = np.array([r[3] for r in rows if r[0] == a])
        e = p.cumsum()
        assert got[a].max_drawdown == pytest.approx(min((e - np.maximum.accumulate(e)).min(), 0)) == pytest.approx(last[a].max_drawdown)
        assert got[a].turnover == np.abs(np.diff(pos, prepend=0)).sum() and got[a].sharpe == pytest.approx(p.mean() / p.std(ddof=1))
    port = tw.portfolio_report(df, "asset", ["i"]).orderBy("i").collect()
    assert len(port) == 30 and port[-1].cum_cost == pytest.approx(6.0) and port[-1].turnover == got["x"].turnover + got["y"].turnover
