"""Keyed sequential kernels: state machines whose output depends on earlier outputs or on unbounded history.

A kernel is a class with `step(*inputs) -> outputs` over valid rows (no input missing) and plain attributes as state,
so that it can be pickled between micro-batches; `block` may do many steps at once and must leave the same state. In a
batch job a partition's rows are sorted by key and order and streamed through in Arrow batches: a worker holds one batch
and the state of one key, whatever the key's size. All kernels that are ready at one time share one such pass."""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.registry import REQUIRED, decay, operator

NAN = float("nan")


class Kernel:
    """Base of all kernels."""

    n_out = 1
    #: Whether missing inputs are passed on to the kernel.
    sparse = False
    #: Whether outputs depend on a bounded number of rows.
    finite = False

    def step(self, *x: float):
        raise NotImplementedError

    def block(self, *x: np.ndarray) -> list[np.ndarray]:
        """Outputs for arrays of valid rows."""
        rows = [self.step(*r) for r in zip(*(a.tolist() for a in x), strict=True)]
        if self.n_out == 1:
            return [np.array(rows, float)]
        return [np.array(c, float) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * self.n_out


def kernel(name: str, n_in: int = 1, outputs: str | tuple[str, ...] = ("",), **params):
    """Registers a kernel class; its constructor takes the operator's parameters."""

    def add(cls: type[Kernel]) -> type[Kernel]:
        outs = outputs.split() if isinstance(outputs, str) else outputs
        cls.n_out = len(outs)
        operator(name, "kernel", n_in, outputs, **params)(cls)
        return cls

    return add


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Whether each row's key differs from that of the row before (row 0: False)."""
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out[1:] |= differ | nulls
    return out


def run_kernels(df: DataFrame, key: list[str], order: list[str], jobs: list, keep: set[str] | None = None, onward: list[str] | None = None) -> DataFrame:
    """The frame with the outputs of (node, input columns, output columns) jobs added; a job may use the outputs of those
    before it. With `keep`, only those outputs leave the pass, and with `onward` only those of the frame's columns; what only
    sorts doesn't enter it."""
    from .chains import Chain

    todo = [(n.spec.build, n.params, ins, outs) for n, ins, outs in jobs]
    made = [o for _, _, _, outs in todo for o in outs]
    wanted = [o for o in made if keep is None or o in keep]
    read = list(dict.fromkeys(i for _, _, ins, _ in todo for i in ins if i not in made))
    onward = df.columns if onward is None else onward
    enter = list(dict.fromkeys([*onward, *key, *read]))
    schema = StructType([*(df.schema[c] for c in onward), *(StructField(o, DoubleType()) for o in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Chain | None = None
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            keys = [batch.column(names.index(k)) for k in key]
            now = [k[0].as_py() for k in keys]
            if state is None or now != last:
                state = Chain(todo)
            cuts = [0, *np.flatnonzero(_changes(keys, n)).tolist(), n]
            results = {o: np.empty(n) for o in wanted}
            columns = {i: np.asarray(batch.column(names.index(i)).to_numpy(zero_copy_only=False), float) for i in read}
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s:
                    state = Chain(todo)
                values = state.run({i: c[s:e] for i, c in columns.items()}, e - s)
                for o, out in results.items():
                    out[s:e] = values[o]
            last = [k[n - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in onward), *(pa.array(o, from_pandas=True) for o in results.values())], [*onward, *results])

    dealt = df.repartition(*key) if key else df.coalesce(1)
    return dealt.sortWithinPartitions(*key, *order).select(*enter).mapInArrow(run, schema)


# -- exponentially weighted -------------------------------------------------------------------------------------


def decayed(values: np.ndarray, keep: float, before: float) -> np.ndarray:
    """s[t] = keep * s[t-1] + values[t], starting from `before`."""
    if not len(values):
        return values
    if keep == 0:
        return values.astype(float)
    x = values.astype(float).copy()
    x[0] = (keep * before + x[0]) * (1 - keep)
    return pd.Series(x).ewm(alpha=1 - keep, adjust=False).mean().to_numpy() / (1 - keep)


class Weighted(Kernel):
    """Decayed sums of products of the inputs, of the weights and of their squares."""

    products: tuple[str, ...] = ("x",)

    def __init__(self, com=None, span=None, halflife=None, alpha=None, **rest) -> None:
        self.keep = 1 - decay({"com": com, "span": span, "halflife": halflife, "alpha": alpha})
        self.sums = dict.fromkeys(self.products, 0.0)
        self.weight = self.weight2 = 0.0

    def block(self, *x: np.ndarray) -> list[np.ndarray]:
        n = len(x[0])
        if not n:
            return [np.zeros(0)] * self.n_out
        at = dict(zip("xy", x, strict=False))
        now = {}
        for p in self.products:
            v = at[p[0]]
            for c in p[1:]:
                v = v * at[c]
            now[p] = decayed(v, self.keep, self.sums[p])
            self.sums[p] = float(now[p][-1])
        w, w2 = decayed(np.ones(n), self.keep, self.weight), decayed(np.ones(n), self.keep**2, self.weight2)
        self.weight, self.weight2 = float(w[-1]), float(w2[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            return [np.asarray(self.result({p: s / w for p, s in now.items()}, w * w / w2, *x), float)]

    def step(self, *x: float):
        return float(self.block(*(np.array([v]) for v in x))[0][0])

    def result(self, m: dict[str, np.ndarray], n: np.ndarray, *x: np.ndarray) -> np.ndarray:
        """From the weighted means of the products and the effective sample size."""
        raise NotImplementedError


def _weighted(name: str, products: str, rule, n_in: int = 1) -> None:
    cls = type(name, (Weighted,), {"products": tuple(products.split()), "result": lambda self, m, n, *x: rule(m, n, *x)})
    globals()[name] = kernel(name, n_in, com=None, span=None, halflife=None, alpha=None)(cls)
    cls.__module__ = __name__


def _spread(m, c):
    """The mean square around the mean; nothing where it is within the rounding of the sums that cancel."""
    square = m[c + c]
    v = square - m[c] ** 2
    return np.where(v <= 2.0**-47 * square, 0.0, v)


def _var(m, n, *_):
    return np.where(n > 1, _spread(m, "x") * n / (n - 1), NAN)


def _third(m, n, *_):
    v = m["xx"] - m["x"] ** 2
    g = (m["xxx"] - 3 * m["x"] * m["xx"] + 2 * m["x"] ** 3) / v**1.5
    return np.where(n > 2, g * np.sqrt(n * np.maximum(n - 1, 0)) / (n - 2), NAN)


def _fourth(m, n, *_):
    a, v = m["x"], m["xx"] - m["x"] ** 2
    g = (m["xxxx"] - 4 * a * m["xxx"] + 6 * a * a * m["xx"] - 3 * a**4) / v**2
    return np.where(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g - 3 * (n - 1)), NAN)


def _cov(m, n, *_):
    return np.where(n > 1, (m["xy"] - m["x"] * m["y"]) * n / (n - 1), NAN)


def _corr(m, n, *_):
    v = _spread(m, "x") * _spread(m, "y")
    return np.where((n > 1) & (v > 0), (m["xy"] - m["x"] * m["y"]) / np.sqrt(np.where(v > 0, v, NAN)), NAN)


def _slope(m, n, *_):
    v = _spread(m, "y")
    return np.where((n > 1) & (v > 0), (m["xy"] - m["x"] * m["y"]) / v, NAN)


_weighted("EwMean", "x", lambda m, n, x: m["x"])
_weighted("EwVar", "x xx", _var)
_weighted("EwStd", "x xx", lambda m, n, x: np.sqrt(_var(m, n)))
_weighted("EwZscore", "x xx", lambda m, n, x: (x - m["x"]) / np.where(_var(m, n) > 0, np.sqrt(_var(m, n)), NAN))
_weighted("EwRms", "xx", lambda m, n, x: np.sqrt(m["xx"]))
_weighted("EwSkew", "x xx xxx", _third)
_weighted("EwKurt", "x xx xxx xxxx", _fourth)
_weighted("EwCov", "x y xy", _cov, 2)
_weighted("EwCorr", "x y xx yy xy", _corr, 2)
_weighted("EwBeta", "x y yy xy", _slope, 2)
_weighted("EwAlpha", "x y yy xy", lambda m, n, x, y: m["x"] - _slope(m, n) * m["y"], 2)
_weighted("EwSpread", "x y yy xy", lambda m, n, x, y: x - _slope(m, n) * y, 2)
_weighted("_EwSize", "x", lambda m, n, x: n)


def _macro(name: str, n_in: int = 1, outputs: str | tuple[str, ...] = ("",), **params):
    return operator(name, "macro", n_in, outputs, **params)


def _op(name: str, *a, **k):
    from ..plans.node import make

    return make(name, *a, **k)


EW = {"com": None, "span": None, "halflife": None, "alpha": None}


@_macro("EwKyleLambda", 2, **EW)
def ew_kyle_lambda(flow, ret, **p):
    return _op("EwBeta", **p)(ret, flow)


@_macro("EwResidualStd", 2, **EW)
def ew_residual_std(x, y, **p):
    return _op("EwStd", **p)(_op("EwSpread", **p)(x, y))


@_macro("DEMA", **EW)
def dema(x, **p):
    e = _op("EwMean", **p)(x)
    return _op("Linear2", 2.0, -1.0)(e, _op("EwMean", **p)(e))


@_macro("TEMA", **EW)
def tema(x, **p):
    e1 = _op("EwMean", **p)(x)
    e2 = _op("EwMean", **p)(e1)
    return _op("Add")(_op("Linear2", 3.0, -3.0)(e1, e2), _op("EwMean", **p)(e2))


@_macro("MACD", 1, "macd signal hist", fast=12, slow=26, signal=9)
def macd(x, fast, slow, signal):
    line = _op("Sub")(_op("EwMean", span=fast)(x), _op("EwMean", span=slow)(x))
    smooth = _op("EwMean", span=signal)(line)
    return [line, smooth, _op("Sub")(line, smooth)]


@_macro("TRIX", span=14)
def trix(x, span):
    e = x
    for _ in range(3):
        e = _op("EwMean", span=span)(e)
    p = _op("_Before")(e)
    return _op("Linear", 100.0)(_op("Div")(_op("Sub")(e, p), p))


@operator("_NightDay", "expr", 4)
def night_day(night, day, rs, n):
    from pyspark.sql import functions as F

    k = F.when(n > 1, 0.34 / (1.34 + (n + 1) / F.when(n > 1, n - 1)))
    return night + k * day + (1 - k) * rs


@_macro("EwYangZhangVar", 4, **EW)
def ew_yang_zhang_var(o, h, low, c, **p):
    night = _op("_OvernightReturn")(o, c)
    return _op("_NightDay")(_op("EwVar", **p)(night), _op("EwVar", **p)(_op("_OpenClose")(o, c)), _op("EwMean", **p)(_op("_RogersSatchellTerm")(o, h, low, c)), _op("_EwSize", **p)(night))


@kernel("BayesianRegression", 2, "slope intercept pred_mean pred_std", **EW, prior_precision=1.0, prior_sigma=1.0)
class BayesianRegression(Kernel):
    """Normal-inverse-gamma regression of y on x whose evidence fades towards the prior; it predicts, then learns."""

    def __init__(self, com=None, span=None, halflife=None, alpha=None, prior_precision=1.0, prior_sigma=1.0):
        if prior_precision <= 0 or prior_sigma <= 0:
            raise ValueError("priors must be positive")
        self.keep = 1 - decay({"com": com, "span": span, "halflife": halflife, "alpha": alpha})
        # precision of (intercept, slope) as (11, 12, 22), their moments, the squares, the shape
        self.prior = (prior_precision, 0.0, prior_precision, 0.0, 0.0, 2 * prior_sigma**2, 2.0)
        self.now = self.prior

    def step(self, y, x):
        p11, p12, p22, e1, e2, s, a = (self.keep * v + (1 - self.keep) * p for v, p in zip(self.now, self.prior, strict=True))
        det = p11 * p22 - p12 * p12
        mean = ((p22 * e1 - p12 * e2) + (p11 * e2 - p12 * e1) * x) / det
        rate = 0.5 * (s - (p22 * e1 * e1 - 2 * p12 * e1 * e2 + p11 * e2 * e2) / det)
        spread = math.sqrt(rate / (a - 1) * (1 + (p22 - 2 * p12 * x + p11 * x * x) / det))
        self.now = p11, p12, p22, e1, e2, _, _ = (p11 + 1, p12 + x, p22 + x * x, e1 + y, e2 + x * y, s + y * y, a + 0.5)
        det = p11 * p22 - p12 * p12
        return (p11 * e2 - p12 * e1) / det, (p22 * e1 - p12 * e2) / det, mean, spread


# -- Wilder's smoothing and what rests on it --------------------------------------------------------------------------


class Wilder:
    """The mean of the first n values, then ((n-1) * mean + value) / n."""

    def __init__(self, n: int) -> None:
        self.n, self.seen, self.mean = n, 0, 0.0

    def add(self, x: float) -> float:
        self.seen += 1
        self.mean += (x - self.mean) / min(self.seen, self.n)
        return self.mean if self.seen >= self.n else NAN

    def block(self, x: np.ndarray) -> np.ndarray:
        """add for an array: a decayed sum once the first n values are there."""
        seed = min(max(self.n - self.seen, 0), len(x))
        if not np.isfinite(x).all() or not math.isfinite(self.mean):
            seed = len(x)
        out = np.array([self.add(v) for v in x[:seed].tolist()], float)
        if seed == len(x):
            return out
        rest = decayed(x[seed:] / self.n, (self.n - 1) / self.n, self.mean)
        self.seen, self.mean = self.seen + len(rest), float(rest[-1])
        return np.concatenate([out, rest])


@kernel("_Wilder", window_size=14)
class WilderMean(Kernel):
    def __init__(self, window_size):
        self.mean = Wilder(window_size)

    def step(self, x):
        return self.mean.add(x)

    def block(self, x):
        return [self.mean.block(x)]


@kernel("_WilderRSI", window_size=14, start_policy="strict")
class WilderRSI(Kernel):
    def __init__(self, window_size, start_policy):
        if window_size < 2:
            raise ValueError("window_size must be at least 2")
        self.up, self.down = Wilder(window_size), Wilder(window_size)
        self.last = 0.0 if start_policy == "zero" else None

    def step(self, x):
        last, self.last = self.last, x
        if last is None:
            return NAN
        up, down = self.up.add(max(x - last, 0.0)), self.down.add(max(last - x, 0.0))
        return 50.0 if up + down == 0 else 100 * up / (up + down)

    def block(self, x):
        if not len(x):
            return [np.zeros(0)]
        first = self.last is None
        d = np.diff(x, prepend=x[:1] if first else self.last)[int(first) :]
        self.last = float(x[-1])
        up, down = self.up.block(np.maximum(d, 0.0)), self.down.block(np.maximum(-d, 0.0))
        total = up + down
        with np.errstate(all="ignore"):
            out = np.where(total == 0, 50.0, 100 * up / total)
        return [np.concatenate([[NAN], out]) if first else out]


@_macro("ATR", 3, window_size=14)
def atr(h, low, c, window_size):
    return _op("_Wilder", window_size)(_op("TrueRange")(h, low, c))


@operator("_PercentOf", "expr", 2)
def percent_of(a, b):
    from ..functions.elementwise import divide, num

    return divide(num(100) * a, b)


@_macro("NATR", 3, window_size=14)
def natr(h, low, c, window_size):
    return _op("_PercentOf")(_op("ATR", window_size)(h, low, c), c)


@operator("_ThirdOfThree", "expr", 3)
def third_of_three(a, b, c):
    return c


@operator("_Band", "expr", 2, "lower mid upper", width=2.0)
def band(mid, half, width):
    from ..functions.elementwise import num

    return [mid - num(width) * half, mid, mid + num(width) * half]


@_macro("KeltnerChannels", 3, "lower mid upper", window_size=20, num_atr=2.0)
def keltner(h, low, c, window_size, num_atr):
    out = _op("_Band", num_atr)(_op("EwMean", span=window_size)(_op("_ThirdOfThree")(h, low, c)), _op("ATR", window_size)(h, low, c))
    return [out[0], out[1], out[2]]


@kernel("_Directional", 3, "plus_dm minus_dm plus_di minus_di dx adx", window_size=14)
class Directional(Kernel):
    """Directional movement: Wilder sums of the two movements and of the true range, and what follows from them."""

    def __init__(self, window_size):
        if window_size < 2:
            raise ValueError("window_size must be at least 2")
        self.n, self.last, self.seen, self.sums, self.adx = window_size, None, 0, (0.0, 0.0, 0.0), Wilder(window_size)

    def step(self, h, low, c):
        last, self.last = self.last, (h, low, c)
        if last is None:
            return (NAN,) * 6
        up, down = h - last[0], last[1] - low
        moves = (up if up > max(down, 0) else 0.0, down if down > max(up, 0) else 0.0, max(h - low, abs(h - last[2]), abs(low - last[2])))
        self.seen += 1
        # the seed is a plain sum of n - 1 values
        fade = 1.0 if self.seen < self.n else (self.n - 1) / self.n
        self.sums = tuple(s * fade + m for s, m in zip(self.sums, moves, strict=True))
        plus, minus, span = self.sums
        if self.seen < self.n:
            return (NAN,) * 6
        if span <= 0:
            return plus, minus, NAN, NAN, NAN, NAN
        pdi, mdi = 100 * plus / span, 100 * minus / span
        dx = 100 * abs(pdi - mdi) / (pdi + mdi) if pdi + mdi > 0 else 0.0
        return plus, minus, pdi, mdi, dx, self.adx.add(dx)

    def block(self, h, low, c):
        # the first rows fill the seed
        seed = min(max(self.n - self.seen, 1), len(h))
        if not np.isfinite(h + low + c).all() or not np.isfinite(self.sums).all():
            seed = len(h)
        out = [np.array(v, float) for v in zip(*(self.step(*r) for r in zip(h[:seed].tolist(), low[:seed].tolist(), c[:seed].tolist(), strict=True)), strict=True)] or [np.zeros(0)] * 6
        if seed == len(h):
            return out
        h, low, c = (np.concatenate([[a], b[seed:]]) for a, b in zip(self.last, (h, low, c), strict=True))
        self.last, self.seen = (float(h[-1]), float(low[-1]), float(c[-1])), self.seen + len(h) - 1
        up, down, old = np.diff(h), -np.diff(low), c[:-1]
        moves = (np.where(up > np.maximum(down, 0), up, 0.0), np.where(down > np.maximum(up, 0), down, 0.0), np.maximum(h[1:] - low[1:], np.maximum(np.abs(h[1:] - old), np.abs(low[1:] - old))))
        plus, minus, span = (decayed(m, (self.n - 1) / self.n, s) for m, s in zip(moves, self.sums, strict=True))
        self.sums = float(plus[-1]), float(minus[-1]), float(span[-1])
        with np.errstate(all="ignore"):
            pdi, mdi = (np.where(span > 0, 100 * v / span, NAN) for v in (plus, minus))
            dx = np.where(pdi + mdi > 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), np.where(span > 0, 0.0, NAN))
        adx = np.full(len(dx), NAN)
        adx[span > 0] = self.adx.block(dx[span > 0])
        return [np.concatenate(v) for v in zip(out, (plus, minus, pdi, mdi, dx, adx), strict=True)]


for _name, _n_in, _pick in (("PlusDM", 2, 0), ("MinusDM", 2, 1), ("PlusDI", 3, 2), ("MinusDI", 3, 3), ("DX", 3, 4)):

    @_macro(_name, _n_in, window_size=14)
    def _one(*x, window_size, pick=_pick):
        return _op("_Directional", window_size)(*x, *x[len(x) - (3 - len(x)) :] if len(x) < 3 else ())[pick]


@_macro("ADX", 3, "plus_di minus_di adx", window_size=14)
def adx(h, low, c, window_size):
    d = _op("_Directional", window_size)(h, low, c)
    return [d[2], d[3], d[5]]


@operator("_Back", "window", n=1)
def back(w, x, n):
    from pyspark.sql import functions as F

    return F.lag(x, n).over(w.spec) if n else x


@operator("_Half", "expr", 2)
def half(a, b):
    return (a + b) / 2


@_macro("ADXR", 3, window_size=14)
def adxr(h, low, c, window_size):
    a = _op("_Directional", window_size)(h, low, c)[5]
    return _op("_Half")(a, _op("_Back", window_size - 1)(a))


@kernel("KAMA", window_size=10, fast=2, slow=30)
class Kama(Kernel):
    """Kaufman's average: smoothing by the square of a blend of two rates, weighed by the efficiency of the path."""

    def __init__(self, window_size, fast, slow):
        if window_size < 2 or fast < 1 or slow < 1:
            raise ValueError("window_size must be at least 2, fast and slow at least 1")
        self.rates = 2 / (fast + 1), 2 / (slow + 1)
        self.past, self.n, self.value = deque(maxlen=window_size + 1), window_size, None

    def step(self, x):
        self.past.append(x)
        if len(self.past) <= self.n:
            return NAN
        p = list(self.past)
        path = sum(abs(b - a) for a, b in zip(p, p[1:], strict=False))
        share = abs(x - p[0]) / path if path > 0 else 0.0
        fast, slow = self.rates
        if self.value is None:
            self.value = p[-2]
        self.value += (share * (fast - slow) + slow) ** 2 * (x - self.value)
        return self.value


# -- filters ------------------------------------------------------------------------------------------------------


class Recursive(Kernel):
    """A rational filter in transposed direct form, from rest. Subclasses give (b, a)."""

    def init(self, b, a) -> None:
        n = max(len(b), len(a))
        b, a = [list(map(float, c)) + [0.0] * (n - len(c)) for c in (b, a)]
        self.b, self.a = [c / a[0] for c in b], [c / a[0] for c in a]
        self.z = [0.0] * n

    def step(self, x):
        z, b, a = self.z, self.b, self.a
        y = b[0] * x + z[0]
        for i in range(1, len(b)):
            z[i - 1] = b[i] * x - a[i] * y + z[i]
        return y


def butterworth(order: int, low: float | None, high: float | None, stop: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter; edges as fractions of the Nyquist frequency. Only `high`: low-pass; only
    `low`: high-pass; both: band-pass, or band-stop."""
    if order < 1 or any(f is not None and not 0 < f < 1 for f in (low, high)):
        raise ValueError("order must be positive and cutoffs between 0 and 1")
    poles = -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order))
    warp = lambda f: 4 * math.tan(math.pi * f / 2)
    if low is None:
        w = warp(high)
        zeros, poles, gain = np.zeros(0), poles * w, w**order
    elif high is None:
        w = warp(low)
        gain = (1 / np.prod(-poles)).real
        zeros, poles = np.zeros(order), w / poles
    else:
        if low >= high:
            raise ValueError("low_cutoff must be below high_cutoff")
        w1, w2 = warp(low), warp(high)
        width, centre = w2 - w1, math.sqrt(w1 * w2)
        if stop:
            gain = (1 / np.prod(-poles)).real
            half = width / 2 / poles
            zeros = np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)])
        else:
            gain, half, zeros = width**order, poles * width / 2, np.zeros(order)
        root = np.sqrt(half.astype(complex) ** 2 - centre**2)
        poles = np.concatenate([half + root, half - root])
    gain = gain * (np.prod(4 - zeros) / np.prod(4 - poles)).real
    z = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    return np.real(gain * np.poly(z)), np.real(np.poly((4 + poles) / (4 - poles)))


@kernel("Butter", order=2, cutoff_freq=0.1)
class Butter(Recursive):
    def __init__(self, order, cutoff_freq):
        self.init(*butterworth(order, None, cutoff_freq))


@kernel("ButterHighpass", order=2, cutoff_freq=0.1)
class ButterHighpass(Recursive):
    def __init__(self, order, cutoff_freq):
        self.init(*butterworth(order, cutoff_freq, None))


@kernel("ButterBandpass", order=2, low_cutoff=0.05, high_cutoff=0.2)
class ButterBandpass(Recursive):
    def __init__(self, order, low_cutoff, high_cutoff):
        self.init(*butterworth(order, low_cutoff, high_cutoff))


@kernel("ButterBandstop", order=2, low_cutoff=0.05, high_cutoff=0.2)
class ButterBandstop(Recursive):
    def __init__(self, order, low_cutoff, high_cutoff):
        self.init(*butterworth(order, low_cutoff, high_cutoff, stop=True))


def period_of(period: float | None, cutoff: float | None) -> float:
    """A period in samples from exactly one of a period and a cutoff (fraction of Nyquist)."""
    if (period is None) == (cutoff is None):
        raise ValueError("give exactly one of period and cutoff")
    p = period if cutoff is None else 2 / cutoff
    if p <= 2:
        raise ValueError("the period must be over 2 samples")
    return float(p)


def smoother_taps(p: float):
    """Two-pole smoother."""
    r = math.exp(-math.sqrt(2) * math.pi / p)
    turn = 2 * r * math.cos(math.sqrt(2) * math.pi / p)
    g = (1 - turn + r * r) / 2
    return [g, g, 0.0], [1.0, -turn, r * r]


def _rate(w: float) -> float:
    return (math.cos(w) + math.sin(w) - 1) / math.cos(w)


@kernel("SuperSmoother", period=None, cutoff=None)
class SuperSmoother(Recursive):
    def __init__(self, period, cutoff):
        self.init(*smoother_taps(period_of(period, cutoff)))


@kernel("Decycler", period=None, cutoff=None)
class Decycler(Recursive):
    def __init__(self, period, cutoff):
        r = _rate(2 * math.pi / period_of(period, cutoff))
        self.init([r / 2, r / 2], [1.0, r - 1])


@kernel("_Highpass2", period=48.0)
class Highpass2(Recursive):
    def __init__(self, period):
        r = _rate(0.707 * 2 * math.pi / period)
        g = (1 - r / 2) ** 2
        self.init([g, -2 * g, g], [1.0, -2 * (1 - r), (1 - r) ** 2])


@_macro("RoofingFilter", hp_period=None, lp_period=None, hp_cutoff=None, lp_cutoff=None)
def roofing_filter(x, hp_period, lp_period, hp_cutoff, lp_cutoff):
    return _op("SuperSmoother", period_of(lp_period, lp_cutoff))(_op("_Highpass2", period_of(hp_period, hp_cutoff))(x))


@kernel("KalmanFilter", process_var=0.01, observation_var=1.0, initial_state=0.0, initial_variance=1.0)
class KalmanFilter(Kernel):
    def __init__(self, process_var, observation_var, initial_state, initial_variance):
        if process_var < 0 or observation_var <= 0 or initial_variance < 0:
            raise ValueError("variances must not be negative")
        self.drift, self.noise, self.state, self.variance = process_var, observation_var, initial_state, initial_variance

    def step(self, z):
        v = self.variance + self.drift
        gain = v / (v + self.noise)
        self.state += gain * (z - self.state)
        self.variance = (1 - gain) * v
        return self.state


@kernel("HawkesIntensity", decay=0.9, alpha=1.0, mu=0.0)
class Hawkes(Kernel):
    def __init__(self, decay, alpha, mu):
        if not 0 < decay < 1:
            raise ValueError("decay must be between 0 and 1")
        self.decay, self.alpha, self.mu, self.excited = decay, alpha, mu, 0.0

    def step(self, x):
        out = self.mu + self.excited
        self.excited = self.decay * (self.excited + self.alpha * x)
        return out

    def block(self, x):
        if not len(x) or not np.isfinite(x).all() or not math.isfinite(self.excited):
            return super().block(x)
        after = decayed(self.decay * self.alpha * x, self.decay, self.excited)
        before = np.concatenate([[self.excited], after[:-1]])
        self.excited = float(after[-1])
        return [self.mu + before]


# -- robust cleaning --------------------------------------------------------------------------------------------------

#: The ratio of a normal deviation to its median absolute deviation, as fixed by the operators' definition.
MAD_SCALE = 1.4826


def _median(sorted_values: list[float]) -> float:
    n = len(sorted_values)
    return sorted_values[n // 2] if n % 2 else (sorted_values[n // 2 - 1] + sorted_values[n // 2]) / 2


class Robust:
    """The last n values, with median and median absolute deviation; the newest may be replaced."""

    def __init__(self, n: int, zeros: bool) -> None:
        self.n, self.values = n, deque([0.0] * n if zeros else [], maxlen=n)
        self.sorted = sorted(self.values)

    def _drop(self, x: float) -> None:
        self.sorted.pop(bisect.bisect_left(self.sorted, x))

    def push(self, x: float) -> None:
        if len(self.values) == self.n:
            self._drop(self.values[0])
        self.values.append(x)
        bisect.insort(self.sorted, x)

    def replace_newest(self, x: float) -> None:
        self._drop(self.values[-1])
        self.values[-1] = x
        bisect.insort(self.sorted, x)

    @property
    def full(self) -> bool:
        return len(self.values) == self.n

    def median(self) -> float:
        return _median(self.sorted)

    def deviation(self) -> float:
        m = self.median()
        return _median(sorted(abs(v - m) for v in self.sorted))


def _verdict(output: str, outlier: bool, x: float, clean: float) -> float:
    if output == "flag":
        return float(outlier)
    return x if not outlier else clean if output == "cleaned" else NAN


def _check_output(output: str, allowed: tuple[str, ...], n_sigma: float = 1.0) -> None:
    if output not in allowed:
        raise ValueError(f"output must be one of {', '.join(allowed)}")
    if n_sigma <= 0:
        raise ValueError("n_sigma must be positive")


@kernel("Hampel", window_size=20, n_sigma=3.0, output="cleaned", start_policy="strict")
class Hampel(Kernel):
    """Values far from the window's median, which then replaces them in the window."""

    def __init__(self, window_size, n_sigma, output, start_policy):
        _check_output(output, ("cleaned", "flag", "nan"), n_sigma)
        self.window, self.limit, self.output, self.strict = Robust(window_size, start_policy == "zero"), n_sigma, output, start_policy == "strict"

    def step(self, x):
        w = self.window
        w.push(x)
        if self.strict and not w.full:
            return NAN
        m, scale = w.median(), MAD_SCALE * w.deviation()
        outlier = scale > 0 and abs(x - m) > self.limit * scale
        if outlier:
            w.replace_newest(m)
        return _verdict(self.output, outlier, x, m)

    def block(self, x):
        w, k = self.window, self.window.n
        start = min(max(k - len(w.values), 0), len(x))
        if not np.isfinite(x).all() or not np.isfinite(np.array(w.values)).all():
            start = len(x)
        out = np.array([self.step(v) for v in x[:start].tolist()], float)
        if start == len(x):
            return [out]
        # full windows: many at once up to the next outlier, which changes those after it
        values = np.concatenate([list(w.values)[1 - k :] if k > 1 else [], x[start:]])
        rest, p, span = values[k - 1 :].copy(), k - 1, 64
        while p < len(values):
            m = np.lib.stride_tricks.sliding_window_view(values[p - k + 1 : p + span], k)
            middle = np.median(m, 1)
            scale = MAD_SCALE * np.median(np.abs(m - middle[:, None]), 1)
            far = np.flatnonzero((scale > 0) & (np.abs(m[:, -1] - middle) > self.limit * scale))
            j = p + (int(far[0]) if len(far) else len(m) - 1)
            if self.output == "flag":
                rest[p - k + 1 : j - k + 2] = 0.0
            if len(far):
                clean = float(middle[far[0]])
                rest[j - k + 1] = _verdict(self.output, True, float(values[j]), clean)
                values[j] = clean
            p, span = j + 1, max(16, span // 2) if len(far) else min(2048, span * 2)
        w.values.clear()
        w.values.extend(values[-k:].tolist())
        w.sorted = sorted(w.values)
        return [np.concatenate([out, rest])]


@kernel("ImpulseClip", window_size=20, n_sigma=4.0, output="cleaned", start_policy="strict")
class ImpulseClip(Kernel):
    """Jumps that are large among the last jumps; the value window's median replaces the value."""

    def __init__(self, window_size, n_sigma, output, start_policy):
        _check_output(output, ("cleaned", "flag", "nan"), n_sigma)
        zeros = start_policy == "zero"
        self.values, self.jumps = Robust(window_size, zeros), Robust(window_size, zeros)
        self.limit, self.output, self.strict, self.last = n_sigma, output, start_policy == "strict", 0.0 if zeros else None

    def step(self, x):
        last, self.last = self.last, x
        self.values.push(x)
        if last is None:
            return NAN
        jump = x - last
        self.jumps.push(jump)
        if self.strict and not self.jumps.full:
            return NAN
        scale = MAD_SCALE * self.jumps.deviation()
        outlier = scale > 0 and abs(jump) > self.limit * scale
        m = x
        if outlier:
            m = self.values.median()
            self.values.replace_newest(m)
        return _verdict(self.output, outlier, x, m)


def truncated_normal(a: float, b: float) -> tuple[float, float]:
    """Mean and deviation of a standard normal variable between a and b."""
    density = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi) if math.isfinite(z) else 0.0
    below = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    edge = lambda z: z * density(z) if math.isfinite(z) else 0.0
    mass = below(b) - below(a)
    mean = (density(a) - density(b)) / mass
    return mean, math.sqrt(1 + (edge(a) - edge(b)) / mass - mean * mean)


@kernel("RollingSigmaClip", window_size=20, lower=None, upper=None, output="clipped", start_policy="strict")
class SigmaClip(Kernel):
    """Clips at bounds in deviations; clipped values stay out of the window, whose moments are corrected for that."""

    def __init__(self, window_size, lower, upper, output, start_policy):
        _check_output(output, ("clipped", "mean", "std", "nan"))
        self.low, self.high = -math.inf if lower is None else lower, math.inf if upper is None else upper
        if self.low >= self.high:
            raise ValueError("lower must be below upper")
        self.shift, self.shrink = truncated_normal(self.low, self.high)
        self.k, self.output, self.policy = window_size, output, start_policy
        self.window = deque([0.0] * window_size if start_policy == "zero" else [], maxlen=window_size)
        self.mean = self.std = NAN

    def step(self, x):
        z = (x - self.mean) / self.std if self.std and not math.isnan(self.std) else 0.0
        inside = self.low <= z <= self.high
        if inside:
            self.window.append(x)
            n = len(self.window)
            m = sum(self.window) / n
            # only full windows count under the strict policy
            if n > 1 and (self.policy != "strict" or n == self.k):
                self.std = math.sqrt(sum((v - m) ** 2 for v in self.window) / (n - 1)) / self.shrink
                self.mean = m - self.shift * self.std
        n = len(self.window)
        if n < 2 or (self.policy == "strict" and n < self.k):
            return NAN
        if self.output in ("mean", "std"):
            return self.mean if self.output == "mean" else self.std
        if inside:
            return x
        return NAN if self.output == "nan" else self.mean + (self.low if z < self.low else self.high) * self.std


@kernel("RollingHurst", window_size=256, min_scale=4, method="rs")
class Hurst(Kernel):
    """Slope of the rescaled range over dyadic scales, less its expectation for independent values."""

    def __init__(self, window_size, min_scale, method):
        if method != "rs":
            raise ValueError("method must be rs")
        if min_scale < 4 or window_size < 4 * min_scale:
            raise ValueError("min_scale must be at least 4 and window_size at least four times that")
        self.k, self.tail = window_size, np.zeros(0)
        self.scales = []
        n = min_scale
        while n <= window_size // 2:
            self.scales.append(n)
            n *= 2
        if len(self.scales) < 3:
            raise ValueError("at least three scales are needed")
        self.expected = [self._expected(n) for n in self.scales]

    @staticmethod
    def _expected(n: int) -> float:
        i = np.arange(1, n)
        front = math.gamma((n - 1) / 2) / (math.sqrt(math.pi) * math.gamma(n / 2)) if n <= 340 else 1 / math.sqrt(math.pi * n / 2)
        return front * float(np.sqrt((n - i) / i).sum())

    def block(self, x):
        series = np.concatenate([self.tail, x])
        self.tail = series[-(self.k - 1) :]
        out = np.full(len(x), NAN)
        if len(series) < self.k:
            return [out]
        rows = np.lib.stride_tricks.sliding_window_view(series, self.k)
        logs = np.log(self.scales)
        found = []
        for s in range(0, len(rows), 2048):
            part = rows[s : s + 2048]
            y = []
            for n, e in zip(self.scales, self.expected, strict=True):
                blocks = part[:, : self.k // n * n].reshape(len(part), -1, n)
                d = blocks - blocks.mean(2, keepdims=True)
                path = d.cumsum(2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = ((np.maximum(path.max(2), 0) - np.minimum(path.min(2), 0)) / np.sqrt((d * d).mean(2))).mean(1)
                    y.append(np.log(ratio - e + math.sqrt(0.5 * math.pi * n)))
            y = np.stack(y)
            found.append(((logs - logs.mean())[:, None] * y).sum(0) / ((logs - logs.mean()) ** 2).sum())
        values = np.concatenate(found)
        values[~np.isfinite(values)] = NAN
        out[len(x) - len(values) :] = values
        return [out]

    def step(self, x):
        return float(self.block(np.array([x]))[0][0])


@kernel("VPIN", 2, bucket_volume=1.0, n_buckets=50)
class Vpin(Kernel):
    """Mean imbalance of the last volume buckets; a trade across a bucket's end is split in proportion."""

    def __init__(self, bucket_volume, n_buckets):
        if bucket_volume <= 0 or n_buckets < 1:
            raise ValueError("bucket_volume must be positive and n_buckets at least 1")
        self.volume, self.buy, self.sell, self.done = bucket_volume, 0.0, 0.0, deque(maxlen=n_buckets)

    def step(self, buy, sell):
        buy, sell = max(buy, 0.0), max(sell, 0.0)
        while buy + sell > 0:
            room = self.volume - self.buy - self.sell
            part = min(1.0, room / (buy + sell))
            if buy + sell < room:
                self.buy, self.sell = self.buy + buy, self.sell + sell
                break
            self.done.append(abs(self.buy + buy * part - self.sell - sell * part))
            self.buy = self.sell = 0.0
            buy, sell = buy * (1 - part), sell * (1 - part)
            if part == 1.0:
                break
        n = len(self.done)
        return sum(self.done) / n / self.volume if n == self.done.maxlen else NAN


# -- cycles -----------------------------------------------------------------------------------------------------------

#: Fixed values of the homodyne discriminator: taps at lags 0, 2, 4 and 6, the price weights, and the warm-up.
HILBERT = ((0, 0.0962), (2, 0.5769), (4, -0.5769), (6, -0.0962))
PRICE_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
CYCLE_WARMUP = 40


class Homodyne:
    """Cycle period, phase and amplitude of a price, from the product of the signal with its predecessor."""

    def __init__(self) -> None:
        self.lines = {n: deque([0.0] * 7, maxlen=7) for n in ("price", "smooth", "detrended", "i", "q")}
        self.i = self.q = self.re = self.im = self.raw = self.period = 0.0
        self.phase = self.amplitude = NAN
        self.seen = 0

    def _put(self, line: str, x: float) -> float:
        self.lines[line].appendleft(x)
        return x

    def _turned(self, line: str) -> float:
        d = self.lines[line]
        return sum(c * d[k] for k, c in HILBERT) * (0.075 * self.raw + 0.54)

    def add(self, price: float) -> bool:
        self._put("price", price)
        self._put("smooth", sum(w * self.lines["price"][k] for k, w in enumerate(PRICE_WEIGHTS)))
        self._put("detrended", self._turned("smooth"))
        q, i = self._put("q", self._turned("detrended")), self._put("i", self.lines["detrended"][3])
        blend = lambda new, old: 0.2 * new + 0.8 * old
        i2, q2 = blend(i - self._turned("q"), self.i), blend(q + self._turned("i"), self.q)
        self.re, self.im = blend(i2 * self.i + q2 * self.q, self.re), blend(i2 * self.q - q2 * self.i, self.im)
        self.i, self.q = i2, q2
        period = self.raw
        if self.re and self.im:
            period = 2 * math.pi / math.atan(self.im / self.re)
        if self.raw > 0:
            period = min(max(period, 0.67 * self.raw), 1.5 * self.raw)
        self.raw = blend(min(max(period, 6.0), 50.0), self.raw)
        self.period = 0.33 * self.raw + 0.67 * self.period
        self.phase, self.amplitude = math.degrees(math.atan2(q, i)) % 360.0, math.hypot(i2, q2)
        self.seen += 1
        return self.seen > CYCLE_WARMUP


class Cycle(Kernel):
    """An operator on the cycle; `read` gets the price once the cycle is warm."""

    def __init__(self, **params) -> None:
        self.cycle, self.params = Homodyne(), params

    def step(self, x):
        if self.cycle.add(x):
            return self.read(self.cycle, x)
        return NAN if self.n_out == 1 else (NAN,) * self.n_out


def _cycle(name: str, rule, outputs: str | tuple[str, ...] = ("",)) -> None:
    cls = type(name, (Cycle,), {"read": lambda self, c, x: rule(c), "__module__": __name__})
    globals()[name] = kernel(name, 1, outputs)(cls)


_cycle("DominantCycle", lambda c: c.period)
_cycle("HilbertPhasor", lambda c: (c.i, c.q), "inphase quadrature")
_cycle("CyclePhase", lambda c: c.phase)
_cycle("CycleFrequency", lambda c: 1 / c.period if c.period > 0 else NAN)
_cycle("CycleAmplitude", lambda c: c.amplitude)
_cycle("CycleSine", lambda c: (math.sin(math.radians(c.phase)), math.sin(math.radians(c.phase) + math.pi / 4)), "sine lead")


@kernel("TrendMode", phase_rate_frac=0.5)
class TrendMode(Cycle):
    last = None

    def read(self, c, x):
        last, self.last = self.last, c.phase
        if last is None:
            return 0.0
        turn = (c.phase - last + 180) % 360 - 180
        return float(abs(turn) < self.params["phase_rate_frac"] * 360 / c.period)


@kernel("MAMA", 1, "mama fama", fast_limit=0.5, slow_limit=0.05)
class Mama(Cycle):
    last = value = follow = None

    def read(self, c, x):
        turn = 1.0 if self.last is None else max(self.last - c.phase, 1.0)
        self.last = c.phase
        rate = min(max(self.params["fast_limit"] / turn, self.params["slow_limit"]), self.params["fast_limit"])
        if self.value is None:
            self.value = self.follow = x
        else:
            self.value += rate * (x - self.value)
            self.follow += rate / 2 * (self.value - self.follow)
        return self.value, self.follow


@kernel("InstantaneousTrendline")
class Trendline(Cycle):
    prices = lines = ()

    def read(self, c, x):
        a = 2 / (c.period + 1)
        if len(self.prices) < 2:
            y = x
        else:
            (p1, p2), (y1, y2) = self.prices, (*self.lines, NAN)[:2]
            y = (a - a * a / 4) * x + a * a / 2 * p1 - (a - 0.75 * a * a) * p2 + 2 * (1 - a) * y1 - (1 - a) ** 2 * y2
        self.prices, self.lines = (x, *self.prices)[:2], (y, *self.lines)[:2]
        return y
