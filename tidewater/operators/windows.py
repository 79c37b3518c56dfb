"""Operators over trailing frames: window aggregates over the valid rows of a series.

`w.roll(k)` is the frame of the last k valid rows, `w.past` that of all so far, `w.pos` counts valid rows. Start
policies: strict gives nothing before k valid rows, expanding uses what is there, zero acts as if k zeros came first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.elementwise import divide, erf, flag, log, num
from ..plans.registry import REQUIRED, operator

def nothing() -> Column:
    return F.lit(None).cast("double")


def gate(w, k: int, c: Column) -> Column:
    return F.when(w.pos >= k, c)


def started(w, k: int, policy: str, c: Column) -> Column:
    return gate(w, k, c) if policy == "strict" else c


def at_least(n: Column, k: int, c: Column) -> Column:
    return F.when(n >= k, c)


# -- positional ------------------------------------------------------------------------------------------------


def lagged(w, x: Column, k: int, policy: str = "strict") -> Column:
    """x[t-k] by row, missing rows included."""
    if k == 0:
        return x
    back = F.lag(x, k).over(w.spec)
    if policy == "strict":
        return back
    early = F.row_number().over(w.spec) <= k
    return F.when(early, num(0) if policy == "zero" else F.first(x).over(w.past)).otherwise(back)


@operator("Lag", "window", policy="propagate", window_size=1, start_policy="strict")
def lag(w, x, window_size, start_policy):
    return lagged(w, x, window_size, start_policy)


@operator("Diff", "window", policy="propagate", window_size=1, start_policy="strict")
def diff(w, x, window_size, start_policy):
    return x - lagged(w, x, window_size, start_policy)


@operator("Momentum", "window", policy="propagate", window_size=10, start_policy="strict")
def momentum(w, x, window_size, start_policy):
    return diff(w, x, window_size, start_policy)


@operator("Diff2", "macro", start_policy="strict")
def diff2(x, start_policy):
    from ..plans.node import make

    return make("Diff", 1, start_policy)(make("Diff", 1, start_policy)(x))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b))


@operator("Return", "window", policy="propagate", window_size=1)
def simple_return(w, x, window_size):
    return divide(x, lagged(w, x, window_size)) - 1


@operator("ROCP", "window", policy="propagate", window_size=10)
def rocp(w, x, window_size):
    return simple_return(w, x, window_size)


@operator("ROC", "window", policy="propagate", window_size=10)
def roc(w, x, window_size):
    return num(100) * simple_return(w, x, window_size)


@operator("ROCR", "window", policy="propagate", window_size=10)
def rocr(w, x, window_size):
    return divide(x, lagged(w, x, window_size))


@operator("LogReturn", "window", policy="propagate", window_size=1)
def log_return(w, x, window_size):
    return log(divide(x, lagged(w, x, window_size)))


@operator("Ffill", "window", policy="propagate")
def ffill(w, x):
    return F.last(x, ignorenulls=True).over(w.past)


@operator("RealizedSpread", "window", 2, lag=1)
def realized_spread(w, p, m, lag):
    side = F.signum(p - m)
    return num(2) * F.lag(side, lag).over(w.spec) * (F.lag(p, lag).over(w.spec) - m)


# -- cumulative and expanding ----------------------------------------------------------------------------------


def _cumulative(names: str, rule) -> None:
    for name in names.split():
        operator(name, "window")(rule)


def corrected_skew(x: Column, n: Column, over) -> Column:
    """Adjusted Fisher-Pearson skewness; missing under three values or without spread."""
    g = F.skewness(x).over(over)
    return F.when((n >= 3) & ~F.isnan(g), g * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def corrected_kurt(x: Column, n: Column, over) -> Column:
    """Adjusted excess kurtosis; missing under four values or without spread."""
    g = F.kurtosis(x).over(over)
    return F.when((n >= 4) & ~F.isnan(g), (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g + 6))


def count(x: Column, over) -> Column:
    return F.count(x).over(over).cast("double")


_cumulative("CumSum ExpandingSum", lambda w, x: F.sum(x).over(w.past))
_cumulative("CumProd ExpandingProd", lambda w, x: F.product(x).over(w.past))
_cumulative("CumMax ExpandingMax", lambda w, x: F.max(x).over(w.past))
_cumulative("CumMin ExpandingMin", lambda w, x: F.min(x).over(w.past))
_cumulative("ExpandingMean", lambda w, x: F.avg(x).over(w.past))
_cumulative("ExpandingVar", lambda w, x: F.var_samp(x).over(w.past))
_cumulative("ExpandingStd", lambda w, x: F.stddev_samp(x).over(w.past))
_cumulative("ExpandingSkew", lambda w, x: corrected_skew(x, count(x, w.past), w.past))
_cumulative("ExpandingKurt", lambda w, x: corrected_kurt(x, count(x, w.past), w.past))
_cumulative("First", lambda w, x: F.first(x, ignorenulls=True).over(w.past))
_cumulative("Last", lambda w, x: x)


def drawdown_of(w, x: Column) -> Column:
    peak = F.max(x).over(w.past)
    return F.when(peak != 0, F.try_divide(x, peak) - 1)


_cumulative("Drawdown", drawdown_of)


@operator("MaxDrawdown", "macro")
def max_drawdown(x):
    from ..plans.node import make

    return make("CumMin")(make("Drawdown")(x))


# -- moments ---------------------------------------------------------------------------------------------------


def sums(x: Column, over, powers: int) -> list[Column]:
    out, p = [], x
    for _ in range(powers):
        out.append(F.sum(p).over(over))
        p = p * x
    return out


def rolling_mean(w, x, k, policy):
    f = w.roll(k)
    return F.sum(x).over(f) / num(k) if policy == "zero" else started(w, k, policy, F.avg(x).over(f))


def rolling_var(w, x, k, policy):
    f = w.roll(k)
    if policy == "zero":
        if k < 2:
            return nothing()
        s1, s2 = sums(x, f, 2)
        return F.greatest((s2 - s1 * s1 / num(k)) / num(k - 1), num(0))
    return started(w, k, policy, F.var_samp(x).over(f))


def rolling_std(w, x, k, policy):
    return F.sqrt(rolling_var(w, x, k, policy)) if policy == "zero" else started(w, k, policy, F.stddev_samp(x).over(w.roll(k)))


@operator("RollingMean", "window", window_size=20, start_policy="strict")
def rolling_mean_op(w, x, window_size, start_policy):
    return rolling_mean(w, x, window_size, start_policy)


@operator("RollingSum", "window", window_size=20, start_policy="strict")
def rolling_sum(w, x, window_size, start_policy):
    return started(w, window_size, start_policy, F.sum(x).over(w.roll(window_size)))


@operator("RollingOrderImbalance", "window", window_size=20, start_policy="strict")
def rolling_order_imbalance(w, x, window_size, start_policy):
    return rolling_sum(w, x, window_size, start_policy)


@operator("RollingVar", "window", window_size=20, start_policy="strict")
def rolling_var_op(w, x, window_size, start_policy):
    return rolling_var(w, x, window_size, start_policy)


@operator("RollingStd", "window", window_size=20, start_policy="strict")
def rolling_std_op(w, x, window_size, start_policy):
    return rolling_std(w, x, window_size, start_policy)


@operator("RollingRms", "window", window_size=20, start_policy="strict")
def rolling_rms(w, x, window_size, start_policy):
    return F.sqrt(rolling_mean(w, x * x, window_size, start_policy))


@operator("RollingSkew", "window", window_size=20, start_policy="strict")
def rolling_skew(w, x, window_size, start_policy):
    k, f = window_size, w.roll(window_size)
    if start_policy != "zero":
        return started(w, k, start_policy, corrected_skew(x, count(x, f), f))
    if k < 3:
        return nothing()
    m, m2, m3 = (s / num(k) for s in sums(x, f, 3))
    v = m2 - m * m
    return F.when(v > 0, (m3 - 3 * m * m2 + 2 * m * m * m) / F.pow(v, num(1.5))) * num(math.sqrt(k * (k - 1)) / (k - 2))


@operator("RollingKurt", "window", window_size=20, start_policy="strict")
def rolling_kurt(w, x, window_size, start_policy):
    k, f = window_size, w.roll(window_size)
    if start_policy != "zero":
        return started(w, k, start_policy, corrected_kurt(x, count(x, f), f))
    if k < 4:
        return nothing()
    m, m2, m3, m4 = (s / num(k) for s in sums(x, f, 4))
    v = m2 - m * m
    g = F.when(v > 0, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / (v * v)) - 3
    return num((k - 1) / ((k - 2) * (k - 3))) * (num(k + 1) * g + 6)


@operator("RollingZscore", "window", window_size=20, start_policy="strict")
def rolling_zscore(w, x, window_size, start_policy):
    f = w.roll(window_size)
    return gate(w, window_size, ratio(x - F.avg(x).over(f), F.stddev_samp(x).over(f)))


@operator("Detrend", "window", window_size=20, start_policy="strict")
def detrend(w, x, window_size, start_policy):
    return x - rolling_mean(w, x, window_size, start_policy)


@operator("BollingerBands", "window", 1, "lower mid upper", window_size=20, num_std=2.0, start_policy="strict")
def bollinger(w, x, window_size, num_std, start_policy):
    m, s = rolling_mean(w, x, window_size, start_policy), rolling_std(w, x, window_size, start_policy)
    return [m - num(num_std) * s, m, m + num(num_std) * s]


# -- extremes and order statistics ------------------------------------------------------------------------------


@operator("RollingMin", "window", window_size=20)
def rolling_min(w, x, window_size):
    return F.min(x).over(w.roll(window_size))


@operator("RollingMax", "window", window_size=20)
def rolling_max(w, x, window_size):
    return F.max(x).over(w.roll(window_size))


@operator("RollingMinMax", "window", 1, "min max", window_size=20)
def rolling_min_max(w, x, window_size):
    return [rolling_min(w, x, window_size), rolling_max(w, x, window_size)]


@operator("RollingRange", "window", window_size=20)
def rolling_range(w, x, window_size):
    return rolling_max(w, x, window_size) - rolling_min(w, x, window_size)


def _offset(w, x, k, sign):
    """The place of the newest extreme within the frame, 0 for its oldest row."""
    values = values_of(w, x, k)
    top = F.array_max(values) if sign > 0 else F.array_min(values)
    return (F.size(values) - F.array_position(F.reverse(values), top)).cast("double")


@operator("RollingArgmax", "window", window_size=20)
def rolling_argmax(w, x, window_size):
    return _offset(w, x, window_size, 1)


@operator("RollingArgmin", "window", window_size=20)
def rolling_argmin(w, x, window_size):
    return _offset(w, x, window_size, -1)


@operator("RollingMedian", "window", window_size=20)
def rolling_median(w, x, window_size):
    return F.percentile(x, num(0.5)).over(w.roll(window_size))


@operator("RollingQuantile", "window", window_size=20, quantile=0.5)
def rolling_quantile(w, x, window_size, quantile):
    return gate(w, window_size, F.percentile(x, num(quantile)).over(w.roll(window_size)))


@operator("RollingIqr", "window", window_size=20)
def rolling_iqr(w, x, window_size):
    f = w.roll(window_size)
    return gate(w, window_size, F.percentile(x, num(0.75)).over(f) - F.percentile(x, num(0.25)).over(f))


def values_of(w, x, k, policy: str = "strict") -> Column:
    """The frame's values, oldest first; under the zero policy filled up with zeros in front."""
    values = F.collect_list(x).over(w.roll(k))
    return values if policy != "zero" else F.concat(F.array_repeat(num(0), (F.lit(k) - F.size(values)).cast("int")), values)


def total(values: Column, rule=lambda v: v) -> Column:
    return F.aggregate(values, num(0), lambda a, v: a + rule(v))


def mean_of(values: Column) -> Column:
    return total(values) / F.size(values)


def median_of(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2


@operator("RollingMad", "window", window_size=20, start_policy="strict")
def rolling_mad(w, x, window_size, start_policy):
    v = values_of(w, x, window_size, start_policy)
    return started(w, window_size, start_policy, mean_of(F.transform(F.zip_with(v, F.array_repeat(mean_of(v), F.size(v)), lambda a, m: a - m), F.abs)))


@operator("RollingMedianAD", "window", window_size=20, start_policy="strict")
def rolling_median_ad(w, x, window_size, start_policy):
    v = values_of(w, x, window_size, start_policy)
    return started(w, window_size, start_policy, median_of(F.transform(F.zip_with(v, F.array_repeat(median_of(v), F.size(v)), lambda a, m: a - m), F.abs)))


def rank_of(v: Column, x: Column) -> Column:
    less = F.size(F.filter(v, lambda a: a < x))
    same = F.size(F.filter(v, lambda a: a == x))
    return less + (same + 1) / 2


@operator("RollingRank", "window", window_size=20)
def rolling_rank(w, x, window_size):
    return gate(w, window_size, rank_of(values_of(w, x, window_size), x))


@operator("RollingPercentile", "window", window_size=20)
def rolling_percentile(w, x, window_size):
    return rolling_rank(w, x, window_size) / num(window_size)


@operator("RollingCVaR", "window", window_size=20, alpha=0.05)
def rolling_cvar(w, x, window_size, alpha):
    worst = F.slice(F.array_sort(values_of(w, x, window_size)), 1, max(1, int(alpha * window_size)))
    return gate(w, window_size, -mean_of(worst))


@operator("RollingMaxDrawdown", "window", window_size=252)
def rolling_max_drawdown(w, x, window_size):
    start = F.struct(num(-math.inf).alias("peak"), num(0).alias("worst"))

    def step(acc, p):
        peak = F.greatest(acc["peak"], p)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], F.coalesce(F.when(peak != 0, F.try_divide(p, peak) - 1), num(0))).alias("worst"))

    return gate(w, window_size, F.aggregate(values_of(w, x, window_size), start, step, lambda acc: acc["worst"]))


# -- linear fits -------------------------------------------------------------------------------------------------


def _fit(name: str, k_least: int, rule, **params) -> None:
    @operator(name, "window", **params)
    def fit(w, x, window_size, **rest):
        policy = rest.pop("start_policy", "strict")
        values = values_of(w, x, window_size, policy)
        return started(w, window_size, policy, at_least(F.size(values), k_least, rule(values, **rest)))


def fitted(values: Column, degree: int) -> tuple[Column, ...]:
    """Least squares over places counted from the newest value (0, -1, ...): the coefficients, constant first."""
    n = F.size(values).cast("double")
    at = F.sequence(F.lit(1) - F.size(values), F.lit(0))
    pairs = F.arrays_zip(values.alias("v"), at.alias("p"))
    sum_of = lambda rule: F.aggregate(pairs, num(0), lambda a, z: a + rule(z["v"], z["p"].cast("double")))
    sy, spy = sum_of(lambda v, p: v), sum_of(lambda v, p: v * p)
    s1, s2 = -n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    if degree == 1:
        den = n * s2 - s1 * s1
        slope = F.when(den != 0, F.try_divide(n * spy - s1 * sy, den))
        return (sy - slope * s1) / n, slope
    sppy = sum_of(lambda v, p: v * p * p)
    s3 = -(s1 * s1)
    s4 = n * (n - 1) * (2 * n - 1) * (3 * n * n - 3 * n - 1) / 30
    a11, a12, a22 = s2 - s1 * s1 / n, s3 - s1 * s2 / n, s4 - s2 * s2 / n
    b1, b2 = spy - s1 * sy / n, sppy - s2 * sy / n
    det = a11 * a22 - a12 * a12
    square = F.try_divide(b2 * a11 - b1 * a12, det)
    slope = F.try_divide(b1 * a22 - b2 * a12, det)
    return (sy - slope * s1 - square * s2) / n, slope, square


_fit("RollingPoly1", 2, lambda v, derivative_order: fitted(v, 1)[derivative_order], window_size=20, derivative_order=0, start_policy="strict")
_fit("RollingTSF", 2, lambda v: fitted(v, 1)[0] + fitted(v, 1)[1], window_size=20)
_fit("RollingPoly2", 3, lambda v, derivative_order: fitted(v, 2)[derivative_order] * (2 if derivative_order == 2 else 1), window_size=20, derivative_order=0, start_policy="strict")


@operator("_Pos", "window")
def pos(w, x):
    """The number of the valid row, from 1."""
    return w.pos.cast("double")


@operator("_SlopeSoFar", "window", 2)
def slope_so_far(w, x, p):
    return F.when(F.count(x).over(w.past) >= 2, F.regr_slope(x, p).over(w.past))


@operator("ExpandingSlope", "macro")
def expanding_slope(x):
    from ..plans.node import make

    return make("_SlopeSoFar")(x, make("_Pos")(x))


@operator("_PreviousOrZero", "window")
def previous_or_zero(w, x):
    return F.coalesce(F.lag(x).over(w.spec), num(0))


@operator("_MeanReversion", "window", 2, window_size=20, output="mrr", start_policy="strict")
def mean_reversion(w, y, x, window_size, output, start_policy):
    """A first-order autoregression y = a x + b over the last pairs; x is the value before y, 0 for the first."""
    k = window_size
    f, older = w.roll(k - 1), w.spec.rowsBetween(-(k - 1), -1)
    n = num(k) if start_policy == "zero" else F.least(w.pos.cast("double"), num(k))
    zero = lambda c: F.coalesce(c, num(0))
    sx, sxx = zero(F.sum(y).over(older)), zero(F.sum(y * y).over(older))
    sy, syy, sxy = F.sum(y).over(f), F.sum(y * y).over(f), F.sum(x * y).over(f)
    den, nom = (n - 1) * sxx - sx * sx, (n - 1) * sxy - sx * sy
    a = F.when(den != 0, F.try_divide(nom, den))
    b = (sy - a * sx) / n
    mean = F.try_divide(b, 1 - a)
    spread = F.try_divide(n * syy - sy * sy - a * nom, n * (n - 2))
    out = {"mrr": 1 - a, "mean": mean, "relmean": mean - y, "std": F.when(spread >= 0, F.sqrt(F.greatest(spread, num(0))))}[output]
    return started(w, k, start_policy, out)


@operator("RollingOU", "macro", window_size=20, output="mrr", start_policy="strict")
def rolling_ou(x, window_size, output, start_policy):
    from ..plans.node import make

    if output not in ("mrr", "mean", "relmean", "std"):
        raise ValueError("output must be mrr, mean, relmean or std")
    return make("_MeanReversion", window_size, output, start_policy)(x, make("_PreviousOrZero")(x))


# -- two inputs --------------------------------------------------------------------------------------------------


def co_moments(w, x, y, k, policy):
    """n and the sums of x, y, xx, yy, xy in the frame."""
    f = w.roll(k)
    n = num(k) if policy == "zero" else count(x, f)
    return n, *(F.sum(c).over(f) for c in (x, y, x * x, y * y, x * y))


def _beta(w, x, y, k, policy):
    """(beta, intercept) of x on y."""
    f = w.roll(k)
    if policy == "zero":
        n, sx, sy, _, syy, sxy = co_moments(w, x, y, k, policy)
        b = ratio(n * sxy - sx * sy, n * syy - sy * sy)
        return b, (sx - b * sy) / n
    return started(w, k, policy, F.regr_slope(x, y).over(f)), started(w, k, policy, F.regr_intercept(x, y).over(f))


@operator("RollingCorr", "window", 2, window_size=20, start_policy="strict")
def rolling_corr(w, x, y, window_size, start_policy):
    if start_policy == "zero":
        n, sx, sy, sxx, syy, sxy = co_moments(w, x, y, window_size, "zero")
        v = (n * sxx - sx * sx) * (n * syy - sy * sy)
        return F.when(v > 0, (n * sxy - sx * sy) / F.sqrt(F.when(v > 0, v)))
    f = w.roll(window_size)
    sxx, syy, sxy = (g(x, y).over(f) for g in (F.regr_sxx, F.regr_syy, F.regr_sxy))
    return started(w, window_size, start_policy, F.when((sxx > 0) & (syy > 0), F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))))


@operator("RollingCov", "window", 2, window_size=20, start_policy="strict")
def rolling_cov(w, x, y, window_size, start_policy):
    if start_policy == "zero":
        n, sx, sy, _, _, sxy = co_moments(w, x, y, window_size, "zero")
        return (sxy - sx * sy / n) / num(max(1, window_size - 1))
    return started(w, window_size, start_policy, F.covar_samp(x, y).over(w.roll(window_size)))


@operator("RollingBeta", "window", 2, window_size=20, start_policy="strict")
def rolling_beta(w, x, y, window_size, start_policy):
    return _beta(w, x, y, window_size, start_policy)[0]


@operator("RollingKyleLambda", "window", 2, window_size=20, start_policy="strict")
def rolling_kyle_lambda(w, flow, ret, window_size, start_policy):
    return _beta(w, ret, flow, window_size, start_policy)[0]


@operator("RollingSpread", "window", 2, window_size=20, start_policy="strict")
def rolling_spread(w, x, y, window_size, start_policy):
    return x - _beta(w, x, y, window_size, start_policy)[0] * y


@operator("RollingAlpha", "window", 2, window_size=20, start_policy="strict")
def rolling_alpha(w, x, y, window_size, start_policy):
    return _beta(w, x, y, window_size, start_policy)[1]


@operator("RollingResidualStd", "macro", 2, window_size=20, start_policy="strict")
def rolling_residual_std(x, y, window_size, start_policy):
    from ..plans.node import make

    return make("RollingStd", window_size, start_policy)(make("RollingSpread", window_size, start_policy)(x, y))


@operator("RollingLinearRegression", "window", 2, "slope intercept r2 stderr", window_size=20, start_policy="strict")
def rolling_linear_regression(w, y, x, window_size, start_policy):
    n, sy, sx, syy, sxx, sxy = co_moments(w, y, x, window_size, start_policy)
    f = w.roll(window_size)
    if start_policy == "zero":
        vx, vy, cxy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    else:
        vx, vy, cxy = (g(y, x).over(f) for g in (F.regr_sxx, F.regr_syy, F.regr_sxy))
    ok = (n >= 3) & (vx > 0)
    slope = F.when(ok, F.try_divide(cxy, vx))
    sse = vy - slope * cxy
    out = [slope, (sy - slope * sx) / n, F.when(vy > 0, F.try_divide(slope * cxy, vy)), F.when(ok, F.when(sse > 0, F.sqrt(F.greatest(sse, num(0)) / F.greatest(n - 2, num(1)))).otherwise(num(0)))]
    return [started(w, window_size, start_policy, o) for o in out]


# -- performance -------------------------------------------------------------------------------------------------


def sharpe(w, x, k, periods):
    s = F.stddev_samp(x).over(w.roll(k))
    return gate(w, k, num(math.sqrt(periods)) * F.when(s > 0, F.try_divide(F.avg(x).over(w.roll(k)), s)))


@operator("RollingSharpe", "window", window_size=252, periods_per_year=1.0)
def rolling_sharpe(w, x, window_size, periods_per_year):
    return sharpe(w, x, window_size, periods_per_year)


@operator("RollingInfoRatio", "window", 2, window_size=252, periods_per_year=1.0)
def rolling_info_ratio(w, r, b, window_size, periods_per_year):
    return sharpe(w, r - b, window_size, periods_per_year)


@operator("RollingSortino", "window", window_size=252, periods_per_year=1.0, target=0.0)
def rolling_sortino(w, x, window_size, periods_per_year, target):
    f = w.roll(window_size)
    down = F.sqrt(F.avg(F.pow(F.least(x - num(target), num(0)), num(2))).over(f))
    return gate(w, window_size, num(math.sqrt(periods_per_year)) * F.when(down > 0, F.try_divide(F.avg(x).over(f) - num(target), down)))


@operator("RollingHitRate", "window", window_size=252)
def rolling_hit_rate(w, x, window_size):
    return gate(w, window_size, F.avg(flag(x > 0)).over(w.roll(window_size)))


@operator("RollingDownsideDeviation", "window", window_size=20, mar=0.0, start_policy="strict")
def rolling_downside_deviation(w, x, window_size, mar, start_policy):
    return F.sqrt(rolling_mean(w, F.pow(F.least(x - num(mar), num(0)), num(2)), window_size, start_policy))


@operator("RollingOmega", "window", window_size=20, threshold=0.0)
def rolling_omega(w, x, window_size, threshold):
    f = w.roll(window_size)
    up, down = F.sum(F.greatest(x - num(threshold), num(0))).over(f), F.sum(F.greatest(num(threshold) - x, num(0))).over(f)
    return gate(w, window_size, F.when(down > 0, F.try_divide(up, down)))


@operator("RollingCalmar", "macro", window_size=252, periods_per_year=1.0)
def rolling_calmar(x, window_size, periods_per_year):
    from ..plans.node import make

    worst = make("RollingMaxDrawdown", window_size)(make("CumProd")(make("Linear", 1.0, 1.0)(x)))
    return make("_CalmarRatio", periods_per_year)(make("RollingMean", window_size)(x), worst)


@operator("_CalmarRatio", "expr", 2, periods_per_year=1.0)
def calmar_ratio(mean, worst, periods_per_year):
    return F.when(worst < 0, F.try_divide(num(periods_per_year) * mean, F.abs(worst)))


# -- moving averages and oscillators ------------------------------------------------------------------------------


@operator("WMA", "window", window_size=20, start_policy="strict")
def wma(w, x, window_size, start_policy):
    v = values_of(w, x, window_size, start_policy)
    n = F.size(v).cast("double")
    weighted = total(F.transform(v, lambda a, i: a * (i + 1)))
    return started(w, window_size, start_policy, weighted / (n * (n + 1) / 2))


@operator("TRIMA", "macro", window_size=20)
def trima(x, window_size):
    from ..plans.node import make

    a, b = ((window_size + 1) // 2,) * 2 if window_size % 2 else (window_size // 2 + 1, window_size // 2)
    return make("_After", window_size)(make("RollingMean", b, "expanding")(make("RollingMean", a, "expanding")(x)))


@operator("_After", "window", n=1)
def after(w, x, n):
    """The value from the n-th valid row on."""
    return gate(w, n, x)


@operator("HullMA", "macro", window_size=20)
def hull_ma(x, window_size):
    from ..plans.node import make

    root = int(math.sqrt(window_size))
    raw = make("Linear2", 2.0, -1.0)(make("WMA", max(1, window_size // 2), "expanding")(x), make("WMA", window_size, "expanding")(x))
    return make("_After", window_size + root - 1)(make("WMA", root, "expanding")(raw))


@operator("_Change", "window")
def change(w, x):
    """x less the valid value before, 0 for the first."""
    return F.coalesce(x - F.lag(x).over(w.spec), num(0))


@operator("_CutlerRSI", "window", window_size=14, start_policy="strict")
def cutler_rsi(w, d, window_size, start_policy):
    f = w.roll(window_size)
    up, down = F.sum(F.greatest(d, num(0))).over(f), F.sum(F.greatest(-d, num(0))).over(f)
    return started(w, window_size, start_policy, ratio(num(100) * up, up + down))


@operator("RollingRSI", "macro", window_size=14, method="wilder", start_policy="strict")
def rolling_rsi(x, window_size, method, start_policy):
    from ..plans.node import make

    if method not in ("wilder", "cutler"):
        raise ValueError("method must be wilder or cutler")
    return make("_WilderRSI", window_size, start_policy)(x) if method == "wilder" else make("_CutlerRSI", window_size, start_policy)(make("_Change" if start_policy != "zero" else "_ChangeFromZero")(x))


@operator("_ChangeFromZero", "window")
def change_from_zero(w, x):
    return x - F.coalesce(F.lag(x).over(w.spec), num(0))


def stochastic(w, x, low, high, k):
    lo, hi = F.min(low).over(w.roll(k)), F.max(high).over(w.roll(k))
    return gate(w, k, F.when(hi > lo, num(100) * F.try_divide(x - lo, hi - lo)).otherwise(num(0)))


@operator("_FastK", "window", 3, window_size=14)
def fast_k(w, h, low, c, window_size):
    return stochastic(w, c, low, h, window_size)


@operator("_Together", "expr", 2, "k d")
def together(k, d):
    """Both, or neither where one is missing."""
    return [k, d]


@operator("Stoch", "macro", 3, "k d", fastk_period=14, smooth_k=3, d=3)
def stoch(h, low, c, fastk_period, smooth_k, d):
    from ..plans.node import make

    k = make("RollingMean", smooth_k)(make("_FastK", fastk_period)(h, low, c))
    both = make("_Together")(k, make("RollingMean", d)(k))
    return [both[0], both[1]]


@operator("StochRSI", "macro", 1, "k d", rsi_period=14, stoch_period=14, smooth_k=1, d=3)
def stoch_rsi(x, rsi_period, stoch_period, smooth_k, d):
    from ..plans.node import make

    r = make("RollingRSI", rsi_period)(x)
    return stoch(r, r, r, stoch_period, smooth_k, d)


@operator("WilliamsR", "window", 3, window_size=14)
def williams_r(w, h, low, c, window_size):
    lo, hi = F.min(low).over(w.roll(window_size)), F.max(h).over(w.roll(window_size))
    return gate(w, window_size, F.when(hi > lo, num(-100) * F.try_divide(hi - c, hi - lo)).otherwise(num(0)))


@operator("CCI", "window", 3, window_size=14)
def cci(w, h, low, c, window_size):
    tp = (h + low + c) / 3
    v = values_of(w, tp, window_size)
    m = mean_of(v)
    dev = mean_of(F.zip_with(v, F.array_repeat(m, F.size(v)), lambda a, b: F.abs(a - b)))
    return gate(w, window_size, F.when(dev > num(1e-12) * F.abs(m), F.try_divide(tp - m, num(0.015) * dev)).otherwise(num(0)))


def previous(w, c: Column) -> Column:
    return F.lag(c).over(w.spec)


def true_range(w, h, low, c):
    p = previous(w, c)
    return F.when(p.isNotNull(), F.greatest(h - low, F.abs(h - p), F.abs(low - p)))


@operator("TrueRange", "window", 3)
def true_range_op(w, h, low, c):
    return true_range(w, h, low, c)


@operator("_Pressure", "window", 3, "bp tr")
def pressure(w, h, low, c):
    p = previous(w, c)
    return [F.when(p.isNull(), num(0)).otherwise(c - F.least(low, p)), F.when(p.isNull(), num(0)).otherwise(F.greatest(h, p) - F.least(low, p))]


@operator("_Ultimate", "window", 2, period1=7, period2=14, period3=28)
def ultimate(w, bp, tr, period1, period2, period3):
    share = lambda k: F.when(F.sum(tr).over(w.roll(k)) > 0, F.try_divide(F.sum(bp).over(w.roll(k)), F.sum(tr).over(w.roll(k)))).otherwise(num(0))
    return gate(w, max(period1, period2, period3) + 1, num(100) * (4 * share(period1) + 2 * share(period2) + share(period3)) / 7)


@operator("UltimateOscillator", "macro", 3, period1=7, period2=14, period3=28)
def ultimate_oscillator(h, low, c, period1, period2, period3):
    from ..plans.node import make

    p = make("_Pressure")(h, low, c)
    return make("_Ultimate", period1, period2, period3)(p[0], p[1])


@operator("_SignedFlow", "window", 4, "up down")
def signed_flow(w, h, low, c, v):
    tp = (h + low + c) / 3
    d = F.coalesce(tp - previous(w, tp), num(0))
    return [F.when(d > 0, tp * v).otherwise(num(0)), F.when(d < 0, tp * v).otherwise(num(0))]


@operator("_FlowIndex", "window", 2, window_size=14)
def flow_index(w, up, down, window_size):
    f = w.roll(window_size)
    a, b = F.sum(up).over(f), F.sum(down).over(f)
    return gate(w, window_size + 1, F.when(a + b > 0, num(100) * F.try_divide(a, a + b)).otherwise(num(100)))


@operator("MFI", "macro", 4, window_size=14)
def mfi(h, low, c, v, window_size):
    from ..plans.node import make

    p = make("_SignedFlow")(h, low, c, v)
    return make("_FlowIndex", window_size)(p[0], p[1])


@operator("DonchianChannels", "window", 2, "lower mid upper", window_size=20)
def donchian(w, h, low, window_size):
    lo, hi = F.min(low).over(w.roll(window_size)), F.max(h).over(w.roll(window_size))
    return [gate(w, window_size, c) for c in (lo, (lo + hi) / 2, hi)]


# -- volatility from ranges -----------------------------------------------------------------------------------------


def parkinson_term(h, low):
    return F.pow(log(ratio(h, low)), num(2)) / num(4 * math.log(2))


def garman_klass_term(o, h, low, c):
    return num(0.5) * F.pow(log(ratio(h, low)), num(2)) - num(2 * math.log(2) - 1) * F.pow(log(ratio(c, o)), num(2))


def rogers_satchell_term(o, h, low, c):
    return log(ratio(h, c)) * log(ratio(h, o)) + log(ratio(low, c)) * log(ratio(low, o))


def _range_volatility() -> None:
    from ..plans.node import make

    for name, n_in, term in (("Parkinson", 2, parkinson_term), ("GarmanKlass", 4, garman_klass_term), ("RogersSatchell", 4, rogers_satchell_term)):
        operator(f"_{name}Term", "expr", n_in)(term)

        @operator(f"Rolling{name}Var", "macro", n_in, window_size=20)
        def var(*x, window_size, name=name):
            return make("RollingMean", window_size)(make(f"_{name}Term")(*x))

        @operator(f"Rolling{name}Vol", "macro", n_in, window_size=20)
        def vol(*x, window_size, name=name):
            return make("Sqrt")(make(f"Rolling{name}Var", window_size)(*x))

        @operator(f"Ew{name}Var", "macro", n_in, com=None, span=None, halflife=None, alpha=None)
        def ew_var(*x, name=name, **p):
            return make("EwMean", **p)(make(f"_{name}Term")(*x))

        @operator(f"Ew{name}Vol", "macro", n_in, com=None, span=None, halflife=None, alpha=None)
        def ew_vol(*x, name=name, **p):
            return make("Sqrt")(make(f"Ew{name}Var", **p)(*x))


_range_volatility()


@operator("_OvernightReturn", "window", 2)
def overnight_return(w, o, c):
    return log(ratio(o, previous(w, c)))


@operator("_OpenClose", "expr", 2)
def open_close(o, c):
    return log(ratio(c, o))


@operator("_YangZhang", "expr", 3, k=0.0)
def yang_zhang(overnight, day, rs, k):
    return overnight + num(k) * day + num(1 - k) * rs


@operator("RollingYangZhangVar", "macro", 4, window_size=20)
def rolling_yang_zhang_var(o, h, low, c, window_size):
    from ..plans.node import make

    n = window_size
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    night = make("RollingVar", n)(make("_OvernightReturn")(o, c))
    return make("_YangZhang", k)(night, make("RollingVar", n)(make("_OpenClose")(o, c)), make("RollingMean", n)(make("_RogersSatchellTerm")(o, h, low, c)))


@operator("RollingYangZhangVol", "macro", 4, window_size=20)
def rolling_yang_zhang_vol(o, h, low, c, window_size):
    from ..plans.node import make

    return make("Sqrt")(make("RollingYangZhangVar", window_size)(o, h, low, c))


@operator("EwYangZhangVol", "macro", 4, com=None, span=None, halflife=None, alpha=None)
def ew_yang_zhang_vol(o, h, low, c, **p):
    from ..plans.node import make

    return make("Sqrt")(make("EwYangZhangVar", **p)(o, h, low, c))


# -- volume ----------------------------------------------------------------------------------------------------------


@operator("RollingVWAP", "window", 4, window_size=20)
def rolling_vwap(w, h, low, c, v, window_size):
    f = w.roll(window_size)
    return gate(w, window_size, ratio(F.sum((h + low + c) / 3 * v).over(f), F.sum(v).over(f)))


@operator("_SignedVolumeStep", "window", 2)
def signed_volume_step(w, c, v):
    p = previous(w, c)
    return F.when(p.isNull() | (c > p), v).when(c < p, -v).otherwise(num(0))


@operator("OBV", "macro", 2)
def obv(c, v):
    from ..plans.node import make

    return make("CumSum")(make("_SignedVolumeStep")(c, v))


@operator("AD", "window", 4)
def ad(w, h, low, c, v):
    return F.sum(F.when(h > low, F.try_divide((c - low) - (h - c), h - low) * v).otherwise(num(0))).over(w.past)


@operator("ADOSC", "macro", 4, fast=3, slow=10)
def adosc(h, low, c, v, fast, slow):
    from ..plans.node import make

    a = make("AD")(h, low, c, v)
    return make("Sub")(make("EwMean", span=fast)(a), make("EwMean", span=slow)(a))


# -- filters with finite memory -----------------------------------------------------------------------------------------


def fir(w, x, weights, policy: str = "strict", by_row: bool = False) -> Column:
    """Sum of weights[k] * x[t-k] over valid rows."""
    n = len(weights)
    values = F.collect_list(x).over(w.roll(n))
    taps = F.array(*[num(t) for t in weights])
    out = F.aggregate(F.zip_with(F.reverse(values), F.slice(taps, 1, F.size(values)), lambda a, b: a * b), num(0), lambda a, v: a + v)
    return out if policy != "strict" else F.when((F.row_number().over(w.spec) if by_row else w.pos) >= n, out)


@operator("MovingAverage", "window", taps=(0.25, 0.5, 0.25))
def moving_average(w, x, taps):
    return fir(w, x, list(taps))


def frac_diff_weights(d: float, window_size: int, threshold: float) -> list[float]:
    out = [1.0]
    while len(out) < window_size:
        nxt = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(nxt) < threshold:
            break
        out.append(nxt)
    return out


@operator("FracDiff", "window", d=0.4, window_size=100, threshold=1e-5, start_policy="strict")
def frac_diff(w, x, d, window_size, threshold, start_policy):
    return fir(w, x, frac_diff_weights(d, window_size, threshold), start_policy)


@operator("Propagator", "window", policy="propagate", window_size=20, g0=1.0, gamma=0.5)
def propagator(w, x, window_size, g0, gamma):
    weights = [g0 * (k + 1) ** -gamma for k in range(window_size)]
    whole = F.count(x).over(w.roll(window_size)) == window_size
    return F.when(whole, fir(w, x, weights, by_row=True))


@operator("SchmittTrigger", "window", lower=REQUIRED, upper=REQUIRED, initial=0.0)
def schmitt_trigger(w, x, lower, upper, initial):
    return F.coalesce(F.last(F.when(x > num(upper), num(1)).when(x < num(lower), num(0)), ignorenulls=True).over(w.past), num(initial))


@operator("Hold", "window", n=REQUIRED, release=0.0)
def hold(w, x, n, release):
    return F.coalesce(F.last(F.when(x != 0, x), ignorenulls=True).over(w.roll(n)), num(release))


# -- microstructure -----------------------------------------------------------------------------------------------------


@operator("_TickStep", "window")
def tick_step(w, p):
    return F.coalesce(F.signum(p - previous(w, p)), num(0))


@operator("_CarrySign", "window")
def carry_sign(w, s):
    return F.last(F.when(s != 0, s), ignorenulls=True).over(w.past)


@operator("TickRuleSign", "macro")
def tick_rule_sign(p):
    from ..plans.node import make

    return make("_CarrySign")(make("_TickStep")(p))


@operator("_PairFirst", "expr", 2)
def pair_first(a, b):
    """a where b is there too."""
    return a


@operator("_QuoteRule", "expr", 3, policy="aware")
def quote_rule(p, m, tick):
    return F.when(p > m, num(1)).when(p < m, num(-1)).when(p == m, tick)


@operator("LeeReadySign", "macro", 2)
def lee_ready_sign(p, m):
    from ..plans.node import make

    return make("_QuoteRule")(p, m, make("TickRuleSign")(make("_PairFirst")(p, m)))


@operator("_Illiquidity", "expr", 2)
def illiquidity(ret, notional):
    return ratio(F.abs(ret), notional)


@operator("AmihudIlliquidity", "macro", 2, window_size=20, start_policy="strict")
def amihud(ret, notional, window_size, start_policy):
    from ..plans.node import make

    return make("RollingMean", window_size, start_policy)(make("_Illiquidity")(ret, notional))


@operator("_NormalShare", "expr", 2)
def normal_share(x, s):
    return F.when(s > 0, num(0.5) * (1 + erf(F.try_divide(x, s) / num(math.sqrt(2)))))


@operator("BulkVolumeClassifier", "macro", window_size=20, start_policy="strict")
def bulk_volume_classifier(x, window_size, start_policy):
    from ..plans.node import make

    return make("_NormalShare")(x, make("RollingStd", window_size, start_policy)(x))


@operator("_Step", "window")
def step(w, x):
    """x less the valid value before."""
    return x - previous(w, x)


@operator("_Before", "window")
def before(w, x):
    return previous(w, x)


@operator("_RollFromCov", "expr")
def roll_from_cov(c):
    return F.when(c < 0, 2 * F.sqrt(F.greatest(-c, num(0))))


@operator("RollSpread", "macro", window_size=20, start_policy="strict")
def roll_spread(p, window_size, start_policy):
    from ..plans.node import make

    d = make("_Step")(p)
    return make("_RollFromCov")(make("RollingCov", window_size, start_policy)(d, make("_Before")(d)))


@operator("ContOFI", "window", 4)
def cont_ofi(w, bid, ask, bid_size, ask_size):
    pb, pa, pbs, pas = (previous(w, c) for c in (bid, ask, bid_size, ask_size))
    keep = lambda cond, v: F.when(cond, v).otherwise(num(0))
    return F.when(pb.isNotNull(), keep(bid >= pb, bid_size) - keep(bid <= pb, pbs) - keep(ask <= pa, ask_size) + keep(ask >= pa, pas))
