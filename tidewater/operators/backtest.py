"""Backtest engines and reports. Engines are kernels that return (equity, pnl, position, cost); reports are windows.

Prices that are missing in an order are market orders, as is the constant MARKET."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import flag, num
from ..plans.registry import operator
from .kernels import NAN, Kernel, kernel

MARKET = math.inf
RESULT = "equity pnl position cost"


class Account:
    """A position marked to a price; every fill is charged against the mark."""

    def __init__(self, multiplier: float) -> None:
        if not (multiplier > 0 and math.isfinite(multiplier)):
            raise ValueError("multiplier must be finite and positive")
        self.multiplier, self.position, self.mark, self.equity = multiplier, 0.0, None, 0.0

    def settle(self, mark: float, fills: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float]:
        """Moves the mark, then books (change, price, rate on notional, fee by contract) fills."""
        pnl = 0.0 if self.mark is None else self.position * (mark - self.mark) * self.multiplier
        cost = 0.0
        for change, price, rate, fixed in fills:
            cost += change * (price - mark) * self.multiplier + abs(change) * (fixed + price * self.multiplier * rate)
            self.position += change
        pnl -= cost
        self.mark = mark
        self.equity += pnl
        return self.equity, pnl, self.position, cost


class Engine(Kernel):
    """Shared parameters of the engines. Missing order fields are allowed, so validity is checked in `run`."""

    needs: tuple[int, ...] = ()

    def __init__(self, maker_fee=0.0, taker_fee=0.0, fill="touch", participation_ratio=1.0, tick_size=0.0, min_position=-math.inf, max_position=math.inf, multiplier=1.0, maker_fee_per_contract=0.0, taker_fee_per_contract=0.0, **rest):
        if fill not in ("touch", "breach"):
            raise ValueError("fill must be touch or breach")
        if not 0 < participation_ratio <= 1:
            raise ValueError("participation_ratio must be in (0, 1]")
        if min_position > max_position or tick_size < 0:
            raise ValueError("min_position must not exceed max_position, tick_size not be negative")
        self.maker, self.taker = (maker_fee, maker_fee_per_contract), (taker_fee, taker_fee_per_contract)
        self.touch, self.share, self.tick = fill == "touch", participation_ratio, tick_size
        self.low, self.high = min_position, max_position
        self.account = Account(multiplier)

    def sides(self, bid, bid_size, ask, ask_size):
        """(sign, limit, size, room) of the orders that are there, the buy first; room of the sell is found after it."""
        for sign, price, size in ((1, bid, bid_size), (-1, ask, ask_size)):
            yield sign, price, size

    def room(self, sign: int, position: float) -> float:
        return max(self.high - position if sign > 0 else position - self.low, 0.0)

    def orders_to(self, target: float):
        """The market order that moves the position to the target, within the limits."""
        move = min(max(target, self.low), self.high) - self.account.position
        return MARKET, max(move, 0.0), -MARKET, max(-move, 0.0)

    def trade(self, mark: float, quotes, find):
        """Settles what `find` fills of each side's order; the sell sees the position after the buy."""
        fills, position = [], self.account.position
        for sign, price, size in self.sides(*quotes):
            got = find(sign, price, size, self.room(sign, position))
            if got:
                amount, at, taker = got
                if amount > 0:
                    fills.append((sign * amount, at, *(self.taker if taker else self.maker)))
                    position += sign * amount
        return self.account.settle(mark, fills)


def limit_of(sign: int, price: float) -> float:
    return sign * MARKET if math.isnan(price) else price


class BarEngine(Engine):
    """Orders against bars: resting orders fill when the bar reaches them, market orders at the open."""

    def bar(self, quotes, o, h, low, c):
        def find(sign, price, size, room):
            if math.isnan(size) or size <= 0:
                return None
            limit = limit_of(sign, price)
            amount = min(size, self.share * size, room)
            if limit == sign * MARKET:
                return amount, o + sign * self.tick, True
            reach = low if sign > 0 else h
            hit = sign * (limit - reach) > 0 or (self.touch and limit == reach)
            return (amount, limit, False) if hit else None

        return self.trade(c, quotes, find)


class TapeEngine(Engine):
    """Orders against prints: a print through the limit fills all, one at it a share of its size."""

    def print_(self, quotes, price_now, size_now):
        def find(sign, price, size, room):
            if math.isnan(size) or size <= 0:
                return None
            limit = limit_of(sign, price)
            if sign * (limit - price_now) > 0:
                taker = math.isinf(limit)
                return min(size, room), price_now if taker else limit, taker
            if self.touch and price_now == limit:
                return min(size, self.share * size_now, room), limit, False
            return None

        return self.trade(price_now, quotes, find)


class BookEngine(Engine):
    """Orders against the best quotes, marked to the middle. `resting` tells which sides' orders were there before,
    `locked` which of them have met the other side's price already."""

    def __init__(self, **p):
        super().__init__(**p)
        self.resting, self.locked = {1: False, -1: False}, {1: False, -1: False}

    def sweep(self, sign, amount, other, other_size):
        """The average price of taking the displayed size, and the rest a tick worse."""
        shown = min(amount, other_size)
        return (shown * other + (amount - shown) * (other + sign * self.tick)) / amount

    def book(self, quotes, bid, ask, bid_size, ask_size):
        def find(sign, price, size, room):
            if math.isnan(price) or math.isnan(size) or size <= 0 or room <= 0:
                self.resting[sign] = self.locked[sign] = False
                return None
            other, other_size = (ask, ask_size) if sign > 0 else (bid, bid_size)
            amount, was = min(size, room), self.resting[sign]
            if sign * (price - other) > 0:
                self.resting[sign] = self.locked[sign] = False
                return (amount, price, False) if was else (amount, self.sweep(sign, amount, other, other_size), True)
            first = other == price and not self.locked[sign]
            self.resting[sign], self.locked[sign] = True, other == price
            return (min(amount, self.share * other_size), price, False) if first and self.touch else None

        return self.trade((bid + ask) / 2, quotes, find)

    def book_and_tape(self, quotes, bid, ask, bid_size, ask_size, price_now, size_now):
        traded = not (math.isnan(price_now) or math.isnan(size_now))

        def find(sign, price, size, room):
            if math.isnan(price) or math.isnan(size) or size <= 0 or room <= 0:
                self.resting[sign] = False
                return None
            other, other_size = (ask, ask_size) if sign > 0 else (bid, bid_size)
            amount, was = min(size, room), self.resting[sign]
            crossed = sign * (price - other) > 0
            self.resting[sign] = not crossed
            if crossed and not was:
                return amount, self.sweep(sign, amount, other, other_size), True
            if traded:
                if sign * (price - price_now) > 0:
                    return amount, price, False
                return (min(amount, self.share * size_now), price, False) if self.touch and price_now == price else None
            return (amount, price, False) if crossed else None

        return self.trade((bid + ask) / 2, quotes, find)


ORDERS = {"maker_fee": 0.0, "taker_fee": 0.0, "fill": "touch", "participation_ratio": 1.0, "tick_size": 0.0, "min_position": -math.inf, "max_position": math.inf, "multiplier": 1.0, "maker_fee_per_contract": 0.0, "taker_fee_per_contract": 0.0}
TARGET = {"taker_fee": 0.0, "tick_size": 0.0, "min_position": -math.inf, "max_position": math.inf, "multiplier": 1.0, "fee_per_contract": 0.0}


def _engine(name: str, n_in: int, needs: tuple[int, ...], **params):
    """Registers an engine whose inputs `needs` must be there; the others may be missing."""

    def add(cls):
        def block(self, *x):
            import numpy as np

            rows = []
            for r in zip(*(a.tolist() for a in x), strict=True):
                rows.append((NAN,) * 4 if any(math.isnan(r[i]) for i in needs) else self.step(*r))
            return [np.array(c, float) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 4

        cls.block = block
        cls.sparse = True
        return kernel(name, n_in, RESULT, **params)(cls)

    return add


def _target_params(p):
    return {"taker_fee": p["taker_fee"], "tick_size": p["tick_size"], "min_position": p["min_position"], "max_position": p["max_position"], "multiplier": p["multiplier"], "taker_fee_per_contract": p["fee_per_contract"]}


@_engine("BacktestPriceTarget", 2, (0, 1), spread=0.0, fee=0.0, min_position=-math.inf, max_position=math.inf, multiplier=1.0, fee_per_contract=0.0)
class PriceTarget(Kernel):
    """Moves to the signal at once, half a spread away from the price."""

    def __init__(self, spread, fee, min_position, max_position, multiplier, fee_per_contract):
        if spread < 0 or min_position > max_position:
            raise ValueError("spread must not be negative, min_position not exceed max_position")
        self.spread, self.rate, self.low, self.high, self.fixed = spread, fee, min_position, max_position, fee_per_contract
        self.account = Account(multiplier)

    def step(self, signal, price):
        move = min(max(signal, self.low), self.high) - self.account.position
        side = (move > 0) - (move < 0)
        return self.account.settle(price, [(move, price * (1 + side * self.spread / 2), self.rate, self.fixed)])


@_engine("BacktestOHLCOrders", 8, (4, 5, 6, 7), **ORDERS)
class OhlcOrders(BarEngine):
    def step(self, bid, bid_size, ask, ask_size, o, h, low, c):
        return self.bar((bid, bid_size, ask, ask_size), o, h, low, c)


@_engine("BacktestOHLCTarget", 5, (), **TARGET)
class OhlcTarget(BarEngine):
    """A target that is known at one bar is traded at the next bar's open."""

    def __init__(self, **p):
        super().__init__(**_target_params(p))
        self.pending = NAN

    def step(self, target, o, h, low, c):
        quotes = (MARKET, 0.0, -MARKET, 0.0) if math.isnan(self.pending) else self.orders_to(self.pending)
        self.pending = target
        return (NAN,) * 4 if any(map(math.isnan, (o, h, low, c))) else self.bar(quotes, o, h, low, c)


@_engine("BacktestTradesOrders", 6, (4, 5), **ORDERS)
class TradesOrders(TapeEngine):
    def step(self, bid, bid_size, ask, ask_size, price, size):
        return self.print_((bid, bid_size, ask, ask_size), price, size)


@_engine("BacktestTradesTarget", 3, (0, 1, 2), **TARGET)
class TradesTarget(TapeEngine):
    def __init__(self, **p):
        super().__init__(**_target_params(p))

    def step(self, target, price, size):
        return self.print_(self.orders_to(target), price, size)


@_engine("BacktestL1Orders", 8, (4, 5, 6, 7), **{**ORDERS, "fill": "breach"})
class L1Orders(BookEngine):
    def step(self, bid, bid_size, ask, ask_size, m_bid, m_ask, m_bid_size, m_ask_size):
        return self.book((bid, bid_size, ask, ask_size), m_bid, m_ask, m_bid_size, m_ask_size)


@_engine("BacktestL1Target", 5, (0, 1, 2, 3, 4), **TARGET)
class L1Target(BookEngine):
    def __init__(self, **p):
        super().__init__(**_target_params(p))

    def step(self, target, m_bid, m_ask, m_bid_size, m_ask_size):
        return self.book(self.orders_to(target), m_bid, m_ask, m_bid_size, m_ask_size)


@_engine("BacktestL1TradesOrders", 10, (4, 5, 6, 7), **ORDERS)
class L1TradesOrders(BookEngine):
    def step(self, bid, bid_size, ask, ask_size, m_bid, m_ask, m_bid_size, m_ask_size, price, size):
        return self.book_and_tape((bid, bid_size, ask, ask_size), m_bid, m_ask, m_bid_size, m_ask_size, price, size)


# -- reports ---------------------------------------------------------------------------------------------------------

REPORT = "drawdown cum_cost turnover trades max_drawdown sharpe"


@operator("_ReportParts", "window", 4, "drawdown cum_cost traded sharpe")
def report_parts(w, equity, pnl, position, cost):
    s = F.stddev_samp(pnl).over(w.past)
    moved = F.abs(position - F.coalesce(F.lag(position).over(w.spec), num(0)))
    return [equity - F.max(equity).over(w.past), F.sum(cost).over(w.past), moved, F.when(s > 0, F.try_divide(F.avg(pnl).over(w.past), s))]


@operator("_Moved", "expr")
def moved(x):
    return flag(x > 0)


@operator("_CumMinZero", "window")
def cum_min_zero(w, x):
    return F.least(F.min(x).over(w.past), num(0))


@operator("BacktestReport", "macro", 4, REPORT)
def backtest_report_op(equity, pnl, position, cost):
    from ..plans.node import make

    p = make("_ReportParts")(equity, pnl, position, cost)
    return [p[0], p[1], make("CumSum")(p[2]), make("CumSum")(make("_Moved")(p[2])), make("_CumMinZero")(p[0]), p[3]]


def backtest_report(frame, equity: str = "equity", pnl: str = "pnl", position: str = "position", cost: str = "cost"):
    """(running, summary): the report's columns beside the rows of a Series, and each one's last value by key."""
    from ..frame import Series
    from ..plans.node import make

    node = make("BacktestReport")(equity, pnl, position, cost)
    running = frame.with_columns(**{n: node[n] for n in REPORT.split()})
    at = F.struct(*running.order)
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in REPORT.split()]
    summary = running.df.groupBy(*running.key).agg(*last) if running.key else running.df.agg(*last)
    return Series(running.df, running.key, running.order), summary


def portfolio_report(df: DataFrame, asset: str, time: list[str], equity: str = "equity", pnl: str = "pnl", position: str = "position", cost: str = "cost", key: list[str] = ()) -> DataFrame:
    """The report of a portfolio: assets' rows with equal `time` are summed, turnover and trades from each asset's own
    moves. A time at which any asset's value is missing has an empty report."""
    from ..frame import Series
    from ..plans.node import make

    key, one = list(key), "_tw_one"
    fields = [equity, pnl, position, cost]
    whole = F.lit(True)
    for c in fields:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    from pyspark.sql import Window

    each = Window.partitionBy(*key, asset).orderBy(*time).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.abs(F.col(position) - F.coalesce(F.last(F.when(whole, F.col(position)), ignorenulls=True).over(each), num(0)))
    rows = df.withColumn("_tw_moved", moved).withColumn("_tw_ok", whole)
    total = rows.groupBy(*key, *time).agg(
        *[F.when(F.min("_tw_ok"), F.sum(c)).alias(c) for c in fields], F.when(F.min("_tw_ok"), F.sum("_tw_moved")).alias("_tw_turn"), F.when(F.min("_tw_ok"), F.sum(flag(F.col("_tw_moved") > 0))).alias("_tw_trades")
    )
    frame = Series(total.withColumn(one, F.lit(0)), [*key, one], time)
    p = make("_ReportParts")(equity, pnl, position, cost)
    out = frame.with_columns(drawdown=p[0], cum_cost=p[1], turnover=make("CumSum")("_tw_turn"), trades=make("CumSum")("_tw_trades"), max_drawdown=make("_CumMinZero")(p[0]), sharpe=p[3])
    return out.df.select(*key, *time, *REPORT.split())
