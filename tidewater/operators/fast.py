"""The rolling operators as block kernels, for long windows.

Spark evaluates a sliding frame anew for each row, which costs the window's length. From FAST_FROM valid rows on the same
operators run in the Arrow pass that kernels use, over whole blocks with the last window_size - 1 values carried along.
A window's result is made of its own values only, whatever came before, comes later or is in the batch: a series is cut at
every window_size-th row, and a window is the end of one cut and the start of the next, whose running sums, moments and
extremes are joined. Nothing is ever subtracted from a running sum, so outliers and infinities leave with their rows.
Order statistics are kept in order by pandas or taken from whole windows. Results are those of the window form (tests
hold the two against each other)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from ..plans.registry import OPERATORS, operator
from .kernels import NAN, Kernel
from .windows import frac_diff_weights

#: Window length from which the block form is used.
FAST_FROM = 16
#: Rows of a vectorised pass over whole windows.
_PASS = 4096

FAST: dict[str, str] = {}


class Tail(Kernel):
    """Carries the last k - 1 values; under the zero policy these are zeros at first."""

    finite = True

    def __init__(self, **p) -> None:
        self.p = p
        self.k = self.size(p)
        self.policy = self.policy if self.always else p.get("start_policy", self.policy)
        self.tails: list[np.ndarray] | None = None
        #: The place in the series of the first carried value.
        self.at = self.origin = 0

    policy = "strict"
    #: Whether the start policy parameter has no say.
    always = False

    @staticmethod
    def size(p) -> int:
        return p["window_size"]

    def block(self, *x: np.ndarray) -> list[np.ndarray]:
        if self.tails is None:
            self.tails = [np.zeros(self.k - 1 if self.policy == "zero" else 0)] * len(x)
        full = [np.concatenate([t, v]) for t, v in zip(self.tails, x, strict=True)]
        skip = len(self.tails[0])
        self.tails = [f[len(f) - min(len(f), self.k - 1) :] for f in full]
        self.origin, self.at = self.at, self.at + len(full[0]) - len(self.tails[0])
        if not len(x[0]):
            return [np.zeros(0)] * self.n_out
        with np.errstate(all="ignore"):
            out = self.frame(*full)
        return [np.asarray(o, float)[skip:] for o in (out if isinstance(out, (list, tuple)) else [out])]

    def step(self, *x: float):
        out = [float(o[0]) for o in self.block(*(np.array([v]) for v in x))]
        return out[0] if self.n_out == 1 else tuple(out)

    # -- what rules are made of -------------------------------------------------------------------------------------

    def cuts(self, a: np.ndarray) -> np.ndarray:
        """The values as rows of window_size, cut where the series' places are its multiples; what is missing at both
        ends is zero and meets no window that is asked for."""
        lead = self.origin % self.k
        out = np.zeros(-(-(lead + len(a)) // self.k) * self.k)
        out[lead : lead + len(a)] = a
        return out.reshape(-1, self.k)

    def flat(self, m: np.ndarray, n: int) -> np.ndarray:
        lead = self.origin % self.k
        return m.ravel()[lead : lead + n]

    def across(self, n: int) -> np.ndarray:
        """The rows whose window begins in the cut before."""
        i = np.arange(n)
        return i[(i >= self.k - 1) & ((self.origin + i) % self.k != self.k - 1)]

    def run(self, a: np.ndarray, rule: np.ufunc) -> np.ndarray:
        """rule (np.add, np.maximum, np.minimum) over each window."""
        m, n = self.cuts(a), len(a)
        out, ends = self.flat(rule.accumulate(m, 1), n).copy(), self.flat(rule.accumulate(m[:, ::-1], 1)[:, ::-1], n)
        i = self.across(n)
        out[i] = rule(ends[i - self.k + 1], out[i])
        return out

    def sum(self, a: np.ndarray) -> np.ndarray:
        return self.gate(self.run(a, np.add))

    def mean(self, a: np.ndarray) -> np.ndarray:
        return self.gate(self.run(a, np.add) / self.n(a))

    def max(self, a: np.ndarray) -> np.ndarray:
        return self.gate(self.run(a, np.maximum))

    def min(self, a: np.ndarray) -> np.ndarray:
        return self.gate(self.run(a, np.minimum))

    def central(self, x: np.ndarray, powers: int) -> list[np.ndarray]:
        """n, the mean and the central sums of the powers from 2 on. Each part of a window is summed about a value of
        its own, and the two parts' moments are joined."""
        m, size = self.cuts(x), len(x)
        place = (self.origin + np.arange(size)) % self.k

        def part(rows: np.ndarray, back: bool, n: np.ndarray) -> list[np.ndarray]:
            about = rows[:, :1]
            d, sums, p = rows - about, [], 1.0
            for _ in range(powers):
                p = p * d
                c = np.cumsum(p, 1)
                sums.append(self.flat(c[:, ::-1] if back else c, size))
            about = self.flat(np.broadcast_to(about, rows.shape), size)
            t = sums[0] / n
            out = [n, about + t, np.maximum(sums[1] - t * sums[0], 0)]
            if powers > 2:
                out.append(sums[2] - 3 * t * sums[1] + 2 * n * t**3)
            if powers > 3:
                out.append(sums[3] - 4 * t * sums[2] + 6 * t * t * sums[1] - 3 * n * t**4)
            return out

        new = part(m, False, place + 1.0)
        old = part(m[:, ::-1], True, self.k - place.astype(float))
        i = self.across(size)
        if len(i):
            na, ma, *ca = (v[i - self.k + 1] for v in old)
            nb, mb, *cb = (v[i] for v in new)
            n, d = na + nb, mb - ma
            joint = [n, ma + d * nb / n, ca[0] + cb[0] + d * d * na * nb / n]
            if powers > 2:
                joint.append(ca[1] + cb[1] + d**3 * na * nb * (na - nb) / n**2 + 3 * d * (na * cb[0] - nb * ca[0]) / n)
            if powers > 3:
                joint.append(ca[2] + cb[2] + d**4 * na * nb * (na * na - na * nb + nb * nb) / n**3 + 6 * d * d * (na * na * cb[0] + nb * nb * ca[0]) / n**2 + 4 * d * (na * cb[1] - nb * ca[1]) / n)
            for v, j in zip(new, joint, strict=True):
                v[i] = j
        return new

    def var(self, x: np.ndarray) -> np.ndarray:
        n, _, c2 = self.central(x, 2)
        return self.gate(np.where(n > 1, c2 / np.maximum(n - 1, 1), NAN))

    def std(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(self.var(x))

    def ordered(self, x: np.ndarray, kept, rule) -> np.ndarray:
        """An order statistic: from a rolling order where all values are finite, else by rule from whole windows."""
        if np.isfinite(x).all():
            return kept(pd.Series(x).rolling(self.k, min_periods=1 if self.policy in ("expanding", "open") else self.k)).to_numpy()
        return self.windows(x, rule)

    def quantile(self, x: np.ndarray, q: float) -> np.ndarray:
        def rule(m: np.ndarray) -> np.ndarray:
            s, place = np.sort(m, 1), q * (m.shape[1] - 1)
            low, up = s[:, math.floor(place)], s[:, math.ceil(place)]
            share = place - math.floor(place)
            return np.where(low == up, low, (1 - share) * low + share * up)

        return self.ordered(x, lambda r: r.quantile(q), rule)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.ordered(x, lambda r: r.rank(), lambda m: (m < m[:, -1:]).sum(1) + ((m == m[:, -1:]).sum(1) + 1) / 2)

    def n(self, a: np.ndarray) -> np.ndarray:
        return np.minimum(np.arange(1, len(a) + 1), self.k)

    def gate(self, out: np.ndarray) -> np.ndarray:
        out = np.array(out, float)
        if self.policy not in ("expanding", "open"):
            out[: self.k - 1] = NAN
        return out

    def windows(self, a: np.ndarray, rule) -> np.ndarray:
        """rule over whole windows, a matrix at a time; the growing windows at the start one by one where the policy
        wants them."""
        out = np.full(len(a), NAN)
        if self.policy in ("expanding", "open"):
            for i in range(min(self.k - 1, len(a))):
                out[i] = rule(a[None, : i + 1])[0]
        if len(a) >= self.k:
            rows = np.lib.stride_tricks.sliding_window_view(a, self.k)
            for s in range(0, len(rows), _PASS):
                out[self.k - 1 + s : self.k - 1 + s + _PASS] = rule(rows[s : s + _PASS])
        return out

    def weighted(self, a: np.ndarray, weights) -> np.ndarray:
        """Sum of weights[i] * a[t-i] over what is there."""
        return np.convolve(a, weights)[: len(a)]

    def pair(self, x: np.ndarray, y: np.ndarray):
        """n, means, central sums of both inputs and of their product."""
        n, mx, cx = self.central(x, 2)
        _, my, cy = self.central(y, 2)
        a, b, size = self.cuts(x), self.cuts(y), len(x)
        place = (self.origin + np.arange(size)) % self.k

        def part(u: np.ndarray, v: np.ndarray, back: bool, n: np.ndarray) -> list[np.ndarray]:
            turn = lambda c: self.flat(c[:, ::-1] if back else c, size)
            du, dv = u - u[:, :1], v - v[:, :1]
            su, sv, suv = (turn(np.cumsum(c, 1)) for c in (du, dv, du * dv))
            about = [self.flat(np.broadcast_to(w[:, :1], w.shape), size) for w in (u, v)]
            return [n, about[0] + su / n, about[1] + sv / n, suv - su * sv / n]

        out = part(a, b, False, place + 1.0)
        old = part(a[:, ::-1], b[:, ::-1], True, self.k - place.astype(float))
        i = self.across(size)
        na, ua, va, ca = (w[i - self.k + 1] for w in old)
        nb, ub, vb, cb = (w[i] for w in out)
        out[3][i] = ca + cb + (ub - ua) * (vb - va) * na * nb / (na + nb)
        return n, mx, my, cx, cy, out[3]


def fast(name: str, rule, policy: str = "strict", size=None, always: bool = False) -> None:
    """Registers the block form of an operator; policy is that of operators without a start policy (open: no gate)."""
    spec = OPERATORS[name]
    body = {"frame": lambda self, *a: rule(self, *a), "policy": policy, "always": always, "__module__": __name__, "n_out": len(spec.outputs)}
    if size:
        body["size"] = staticmethod(size)
    cls = type(f"_Fast{name}", (Tail,), body)
    globals()[cls.__name__] = cls
    operator(cls.__name__, "kernel", spec.n_in, spec.outputs, spec.policy, **spec.params)(cls)
    FAST[name] = cls.__name__


def ratio(a, b):
    return np.where(b != 0, a / np.where(b != 0, b, NAN), NAN)


def positive(a, b):
    return np.where(b > 0, a / np.where(b > 0, b, NAN), NAN)


fast("RollingMean", lambda w, x: w.mean(x))
fast("RollingSum", lambda w, x: w.sum(x))
fast("RollingOrderImbalance", lambda w, x: w.sum(x))
fast("RollingVar", lambda w, x: w.var(x))
fast("RollingStd", lambda w, x: w.std(x))
fast("RollingRms", lambda w, x: np.sqrt(w.mean(x * x)))
fast("RollingZscore", lambda w, x: w.gate(ratio(x - w.mean(x), w.std(x))), always=True)
fast("Detrend", lambda w, x: x - w.mean(x))
fast("BollingerBands", lambda w, x: [w.mean(x) + c * w.p["num_std"] * w.std(x) if c else w.mean(x) for c in (-1, 0, 1)])
fast("RollingMin", lambda w, x: w.min(x), "open")
fast("RollingMax", lambda w, x: w.max(x), "open")
fast("RollingMinMax", lambda w, x: [w.min(x), w.max(x)], "open")
fast("RollingRange", lambda w, x: w.max(x) - w.min(x), "open")
fast("RollingMedian", lambda w, x: w.quantile(x, 0.5), "open")
fast("RollingQuantile", lambda w, x: w.quantile(x, w.p["quantile"]))
fast("RollingIqr", lambda w, x: w.quantile(x, 0.75) - w.quantile(x, 0.25))
fast("RollingRank", lambda w, x: w.rank(x))
fast("RollingPercentile", lambda w, x: w.rank(x) / w.k)
fast("RollingArgmax", lambda w, x: w.windows(x, lambda m: m.shape[1] - 1 - m[:, ::-1].argmax(1)), "open")
fast("RollingArgmin", lambda w, x: w.windows(x, lambda m: m.shape[1] - 1 - m[:, ::-1].argmin(1)), "open")
fast("RollingMad", lambda w, x: w.windows(x, lambda m: np.abs(m - m.mean(1, keepdims=True)).mean(1)))
fast("RollingMedianAD", lambda w, x: w.windows(x, lambda m: np.median(np.abs(m - np.median(m, 1, keepdims=True)), 1)))
fast("RollingCVaR", lambda w, x: w.windows(x, lambda m: -np.partition(m, max(1, int(w.p["alpha"] * w.k)) - 1, 1)[:, : max(1, int(w.p["alpha"] * w.k))].mean(1)))
fast("RollingHitRate", lambda w, x: w.mean((x > 0).astype(float)))
fast("RollingDownsideDeviation", lambda w, x: np.sqrt(w.mean(np.minimum(x - w.p["mar"], 0) ** 2)))


def _skew(w, x):
    n, _, c2, c3 = w.central(x, 3)
    return w.gate(np.where((n > 2) & (c2 > 0), np.sqrt(n * (n - 1)) / np.where(n > 2, n - 2, NAN) * np.sqrt(n) * c3 / np.where(c2 > 0, c2, NAN) ** 1.5, NAN))


def _kurt(w, x):
    n, _, c2, _, c4 = w.central(x, 4)
    g = n * c4 / np.where(c2 > 0, c2, NAN) ** 2 - 3
    return w.gate(np.where(n > 3, (n - 1) / np.where(n > 3, (n - 2) * (n - 3), NAN) * ((n + 1) * g + 6), NAN))


fast("RollingSkew", _skew)
fast("RollingKurt", _kurt)


def _ratio_of_mean(w, x, periods):
    return math.sqrt(periods) * positive(w.mean(x), w.std(x))


fast("RollingSharpe", lambda w, x: w.gate(_ratio_of_mean(w, x, w.p["periods_per_year"])))
fast("RollingInfoRatio", lambda w, r, b: w.gate(_ratio_of_mean(w, r - b, w.p["periods_per_year"])))
fast("RollingSortino", lambda w, x: w.gate(math.sqrt(w.p["periods_per_year"]) * positive(w.mean(x) - w.p["target"], np.sqrt(w.mean(np.minimum(x - w.p["target"], 0) ** 2)))))
fast("RollingOmega", lambda w, x: w.gate(positive(w.sum(np.maximum(x - w.p["threshold"], 0)), w.sum(np.maximum(w.p["threshold"] - x, 0)))))


def _worst(m):
    peak = np.maximum.accumulate(m, 1)
    fall = m / np.where(peak != 0, peak, NAN) - 1
    return np.minimum(np.where(np.isnan(fall), 0, fall).min(1), 0)


fast("RollingMaxDrawdown", lambda w, x: w.windows(x, _worst))


def _line(w, x, degree):
    """Least squares over places counted back from the newest value (0, -1, ...): coefficients, constant first."""
    n = w.n(x).astype(float)
    i = np.arange(w.k, dtype=float)
    sy, sp = w.weighted(x, np.ones(w.k)), -w.weighted(x, i)
    s1, s2 = -n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    if degree == 1:
        slope = ratio(n * sp - s1 * sy, n * s2 - s1 * s1)
        return (sy - slope * s1) / n, slope
    spp, s3, s4 = w.weighted(x, i * i), -(s1 * s1), n * (n - 1) * (2 * n - 1) * (3 * n * n - 3 * n - 1) / 30
    a11, a12, a22, b1, b2 = s2 - s1 * s1 / n, s3 - s1 * s2 / n, s4 - s2 * s2 / n, sp - s1 * sy / n, spp - s2 * sy / n
    det = a11 * a22 - a12 * a12
    square, slope = ratio(b2 * a11 - b1 * a12, det), ratio(b1 * a22 - b2 * a12, det)
    return (sy - slope * s1 - square * s2) / n, slope, square


fast("RollingPoly1", lambda w, x: w.gate(np.where(w.n(x) >= 2, _line(w, x, 1)[w.p["derivative_order"]], NAN)))
fast("RollingTSF", lambda w, x: w.gate(sum(_line(w, x, 1))))
fast("RollingPoly2", lambda w, x: w.gate(np.where(w.n(x) >= 3, _line(w, x, 2)[w.p["derivative_order"]] * (2 if w.p["derivative_order"] == 2 else 1), NAN)))
# the newest value weighs n, which is less than the window's length while it grows
fast("WMA", lambda w, x: w.gate((w.weighted(x, np.arange(w.k, 0, -1.0)) - (w.k - w.n(x)) * w.weighted(x, np.ones(w.k))) / (w.n(x) * (w.n(x) + 1) / 2)))


def _fir(name, taps_of):
    fast(name, lambda w, x: w.gate(w.weighted(x, taps_of(w.p))), size=lambda p: len(taps_of(p)))


_fir("MovingAverage", lambda p: list(p["taps"]))
_fir("FracDiff", lambda p: frac_diff_weights(p["d"], p["window_size"], p["threshold"]))


def _corr(w, x, y):
    _, _, _, vx, vy, c = w.pair(x, y)
    return w.gate(positive(c, np.sqrt(vx) * np.sqrt(vy)))


def _regression(w, x, y):
    """(slope, intercept) of x on y."""
    _, mx, my, _, vy, c = w.pair(x, y)
    slope = positive(c, vy)
    return slope, mx - slope * my


def _full_regression(w, y, x):
    n, my, mx, vy, vx, c = w.pair(y, x)
    ok = (n >= 3) & (vx > 0)
    slope = np.where(ok, positive(c, vx), NAN)
    left = vy - slope * c
    error = np.where(ok, np.sqrt(np.where(left > 1e-12 * vy, left, 0) / np.maximum(n - 2, 1)), NAN)
    return [w.gate(v) for v in (slope, my - slope * mx, positive(slope * c, vy), error)]


fast("RollingCorr", _corr)
fast("RollingCov", lambda w, x, y: w.gate(np.where(w.n(x) > 1, w.pair(x, y)[5] / np.maximum(w.n(x) - 1, 1), NAN)))
fast("RollingBeta", lambda w, x, y: w.gate(_regression(w, x, y)[0]))
fast("RollingKyleLambda", lambda w, flow, ret: w.gate(_regression(w, ret, flow)[0]))
fast("RollingSpread", lambda w, x, y: w.gate(x - _regression(w, x, y)[0] * y))
fast("RollingAlpha", lambda w, x, y: w.gate(_regression(w, x, y)[1]))
fast("RollingLinearRegression", _full_regression)


def _place(w, h, low, c, top, scale, flat=0.0):
    lo, hi = w.min(low), w.max(h)
    return w.gate(np.where(hi > lo, scale * (top(c, lo, hi)) / np.where(hi > lo, hi - lo, NAN), flat))


fast("WilliamsR", lambda w, h, low, c: _place(w, h, low, c, lambda c, lo, hi: hi - c, -100))
fast("_FastK", lambda w, h, low, c: _place(w, h, low, c, lambda c, lo, hi: c - lo, 100))
fast("DonchianChannels", lambda w, h, low: [w.min(low), (w.min(low) + w.max(h)) / 2, w.max(h)])
fast("RollingVWAP", lambda w, h, low, c, v: w.gate(ratio(w.sum((h + low + c) / 3 * v), w.sum(v))))


def _cci(w, h, low, c):
    tp = (h + low + c) / 3
    dev = w.windows(tp, lambda m: np.abs(m - m.mean(1, keepdims=True)).mean(1))
    m = w.mean(tp)
    spread = dev > 1e-12 * np.abs(m)
    return w.gate(np.where(spread, (tp - m) / (0.015 * np.where(spread, dev, NAN)), np.where(np.isnan(dev), NAN, 0.0)))


fast("CCI", _cci)


def choose(name: str, params: dict) -> str:
    """The operator that computes this one: its block form from FAST_FROM rows on."""
    fast_name = FAST.get(name)
    if fast_name is None:
        return name
    return fast_name if OPERATORS[fast_name].build.size(params) >= FAST_FROM else name
