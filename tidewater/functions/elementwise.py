"""Stateless operators: each is one column expression."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..plans.registry import operator

INF = float("inf")
#: Fixed values of the scaled exponential unit.
SELU_SCALE, SELU_ALPHA = 1.0507, 1.67326


def num(x: float) -> Column:
    return F.lit(float(x))


def flag(c: Column) -> Column:
    """1.0 or 0.0."""
    return F.when(c, num(1)).otherwise(num(0))


def divide(a: Column, b: Column) -> Column:
    """IEEE division; 0/0 and what is divided by or into a missing value are missing."""
    return F.when(b != 0, F.try_divide(a, b)).when((b == 0) & (a > 0), num(INF)).when((b == 0) & (a < 0), num(-INF))


def log(x: Column) -> Column:
    """Natural logarithm; minus infinity at zero, missing below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, num(-INF))


@pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore")


@pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def _unary(**rules) -> None:
    for name, rule in rules.items():
        operator(name, "expr")(rule)


def _binary(**rules) -> None:
    for name, rule in rules.items():
        operator(name, "expr", 2)(rule)


_unary(
    Abs=F.abs, Log=log, Exp=F.exp, Sqrt=F.sqrt, Erf=lambda x: erf(x), Erfc=lambda x: erfc(x), Sign=F.signum, Tanh=F.tanh, Sin=F.sin, Cos=F.cos, Atan=F.atan, Asin=F.asin, Acos=F.acos,
    Relu=lambda x: F.greatest(x, num(0)), PosPart=lambda x: F.greatest(x, num(0)), NegPart=lambda x: F.greatest(-x, num(0)),
    Selu=lambda x: F.when(x > 0, num(SELU_SCALE) * x).otherwise(num(SELU_SCALE * SELU_ALPHA) * (F.exp(x) - 1)),
    Elu=lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1), Softsign=lambda x: x / (1 + F.abs(x)), Sigmoid=lambda x: num(1) / (1 + F.exp(-x)),
    Floor=lambda x: F.floor(x).cast("double"), Ceil=lambda x: F.ceil(x).cast("double"), Round=F.rint, Square=lambda x: x * x, Cube=lambda x: x * x * x, Identity=lambda x: x,
    Not=lambda x: flag(x == 0),
)
_binary(
    Hypot=F.hypot, Atan2=F.atan2, Add=lambda x, y: x + y, Sub=lambda x, y: x - y, Mul=lambda x, y: x * y, Div=divide,
    GreaterThan=lambda a, b: flag(a > b), LessThan=lambda a, b: flag(a < b), GreaterEqual=lambda a, b: flag(a >= b), LessEqual=lambda a, b: flag(a <= b), Equal=lambda a, b: flag(a == b), NotEqual=lambda a, b: flag(a != b),
    And=lambda a, b: flag((a != 0) & (b != 0)), Or=lambda a, b: flag((a != 0) | (b != 0)),
    OFI=lambda b, s: F.when(b + s == 0, num(0)).otherwise(F.try_divide(b - s, b + s)), QueueImbalance=lambda b, a: F.when(b + a == 0, num(0)).otherwise(F.try_divide(b - a, b + a)),
    EffectiveSpread=lambda p, m: 2 * F.abs(p - m), SignedVolume=lambda s, v: s * v,
)


@operator("Linear", "expr", scale=1.0, shift=0.0)
def linear(x: Column, scale: float, shift: float) -> Column:
    return x * num(scale) + num(shift)


@operator("Linear2", "expr", 2, a=1.0, b=1.0, c=0.0)
def linear2(x: Column, y: Column, a: float, b: float, c: float) -> Column:
    return x * num(a) + y * num(b) + num(c)


@operator("Power", "expr", p=2.0)
def power(x: Column, p: float) -> Column:
    return F.pow(x, num(p))


@operator("Cart2Polar", "expr", 2, "r theta")
def cart2polar(x: Column, y: Column) -> list[Column]:
    return [F.hypot(x, y), F.atan2(y, x)]


@operator("Polar2Cart", "expr", 2, "x y")
def polar2cart(r: Column, theta: Column) -> list[Column]:
    return [r * F.cos(theta), r * F.sin(theta)]


@operator("Where", "expr", 3, policy="aware")
def where(mask: Column, a: Column, b: Column) -> Column:
    return F.when(mask != 0, a).when(mask == 0, b)


@operator("IsNan", "expr", policy="aware")
def is_nan(x: Column) -> Column:
    return flag(x.isNull())


@operator("IsFinite", "expr", policy="aware")
def is_finite(x: Column) -> Column:
    return flag(x.isNotNull() & (F.abs(x) < num(INF)))


@operator("FillNa", "expr", policy="aware", fill=0.0)
def fill_na(x: Column, fill: float) -> Column:
    return F.coalesce(x, num(fill))


@operator("Clip", "expr", lower=None, upper=None)
def clip(x: Column, lower: float | None, upper: float | None) -> Column:
    x = x if lower is None else F.greatest(x, num(lower))
    return x if upper is None else F.least(x, num(upper))


@operator("BOP", "expr", 4)
def bop(o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.when(h > low, F.try_divide(c - o, h - low)).otherwise(num(0))


@operator("MicroPrice", "expr", 4)
def micro_price(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    share = F.try_divide(bid_size, total)
    return F.when(total > 0, share * ask + (1 - share) * bid).otherwise((bid + ask) / 2)
