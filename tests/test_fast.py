"""Block forms of the rolling operators against their window forms."""

import numpy as np
import pytest

import tidewater as tw
from tidewater.operators import fast
from tidewater.plans.node import make
from tidewater.plans.registry import OPERATORS

N = 400


def frame(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(100, 5, (N, 4)).round(1)
    x[:, 1] = x[:, 0] * 0.5 + rng.normal(0, 1, N)
    x[200:208] = x[200]  # ties
    rows = [("a" if i < 300 else "b", i, *(None if rng.random() < 0.05 else float(v) for v in r)) for i, r in enumerate(x)]
    return tw.series(spark.createDataFrame(rows, "k string, i int, x0 double, x1 double, x2 double, x3 double"), "k", "i")


CASES = [(n, p) for n in fast.FAST for p in (("strict", "expanding", "zero") if "start_policy" in OPERATORS[n].params else (None,))]


def params_of(n, p=None, k=20):
    kw = {"start_policy": p} if p else {}
    if n == "MovingAverage":
        kw["taps"] = tuple(0.9**i for i in range(k))
    elif "window_size" in OPERATORS[n].params:
        kw["window_size"] = k
    return kw


def outs(cases=CASES):
    out = {}
    for n, p in cases:
        node = make(n, **params_of(n, p))(*[f"x{i}" for i in range(OPERATORS[n].n_in)])
        out.update({f"{n}_{p}_{j}": node[j] for j in range(len(OPERATORS[n].outputs))})
    return out


def test_block_forms_equal_window_forms(spark, monkeypatch):

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        quick = frame(spark).select("i", **outs()).orderBy("i").toPandas()
        monkeypatch.setattr(fast, "FAST_FROM", 10**9)
        slow = frame(spark).select("i", **outs()).orderBy("i").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    bad = []
    for c in slow.columns[1:]:
        try:
            np.testing.assert_allclose(quick[c].astype(float), slow[c].astype(float), rtol=1e-6, atol=1e-6)
        except AssertionError:
            q, s = quick[c].astype(float), slow[c].astype(float)
            at = np.flatnonzero(~np.isclose(q, s, rtol=1e-6, atol=1e-6, equal_nan=True))
            bad.append(f"{c}: {len(at)} rows, first {at[:3]}: {q[at[:3]].tolist()} for {s[at[:3]].tolist()}")
    assert not bad, "\n".join(bad)


def run_block(n, p, x, k, cuts=()):
    """All outputs of the block form, the series given in parts."""
    spec = OPERATORS[fast.FAST[n]]
    kernel = spec.build(**{**OPERATORS[n].params, **params_of(n, p, k)})
    at = [0, *cuts, len(x)]
    parts = [kernel.block(*(np.ascontiguousarray(x[s:e, i]) for i in range(spec.n_in))) for s, e in zip(at, at[1:], strict=False)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def outlying(value, n=700, at=300):
    rng = np.random.default_rng(12)
    x = rng.normal(0.5, 1, (n, 4))
    x[:, 1] += x[:, 0]
    clean = x.copy()
    x[at] = value
    return clean, x


@pytest.mark.parametrize("k", [20, 100])
@pytest.mark.parametrize("value", [1e10, np.inf, -np.inf])
def test_outliers_touch_only_their_windows(value, k):
    """What a window gives depends on its own values: not on later ones, not on earlier ones, not on the batch."""
    clean, x = outlying(value)
    for n, p in CASES:
        want, got = run_block(n, p, clean, k), run_block(n, p, x, k, (7, 150, 290, 301, 350))
        for a, b in zip(want, got, strict=True):
            np.testing.assert_allclose(b[:300], a[:300], rtol=1e-9, atol=1e-11, err_msg=f"{n} {p} before")
            np.testing.assert_allclose(b[300 + k :], a[300 + k :], rtol=1e-9, atol=1e-11, err_msg=f"{n} {p} after")


@pytest.mark.parametrize("n,p", [c for c in CASES if c[1] in (None, "strict")], ids=lambda c: str(c))
def test_batches_do_not_matter(n, p):
    clean, _ = outlying(0.0, 500, 0)
    whole = run_block(n, p, clean, 20)
    for cuts in ((1, 2, 3, 19, 20, 21, 40, 41, 399), tuple(range(13, 500, 13))):
        for a, b in zip(whole, run_block(n, p, clean, 20, cuts), strict=True):
            np.testing.assert_allclose(b, a, rtol=1e-12, atol=1e-13)


def test_infinities_as_in_the_window_forms(spark, monkeypatch):
    _, x = outlying(np.inf, 120, 50)
    x[80] = -np.inf
    df = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(x)], "k string, i int, x0 double, x1 double, x2 double, x3 double")
    # median deviations from an infinite median and fits weigh infinities by zero: missing in one form or the other
    cases = [(n, p) for n, p in CASES if p in (None, "strict") and n not in ("RollingMedianAD", "WMA")]
    quick = tw.series(df, "k", "i").select("i", **outs(cases)).orderBy("i").toPandas()
    monkeypatch.setattr(fast, "FAST_FROM", 10**9)
    slow = tw.series(df, "k", "i").select("i", **outs(cases)).orderBy("i").toPandas()
    bad = [c for c in slow.columns[1:] if not np.allclose(quick[c].astype(float), slow[c].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True)]
    assert not bad


@pytest.mark.parametrize("k", [15, 16])
def test_choice_by_window(spark, k):
    plan = frame(spark).select("i", m=tw.ops.RollingMean(k)("x0"))._jdf.queryExecution().executedPlan().toString()
    assert ("MapInArrow" in plan) == (k >= fast.FAST_FROM) and ("Window" in plan) == (k < fast.FAST_FROM)


def test_windows_without_spread():
    x = np.concatenate([np.arange(30.0), np.full(60, 7.25), np.arange(30.0)])
    y = np.arange(120.0) % 7
    run = lambda n, *a, **p: fast.__dict__[fast.FAST[n]](**{**OPERATORS[n].params, "window_size": 20, **p}).block(*a)[0][60:85]
    assert (run("RollingStd", x) == 0).all() and (run("RollingMean", x) == 7.25).all() and (run("RollingIqr", x) == 0).all()
    for n in ("RollingZscore", "RollingSkew", "RollingKurt"):
        assert np.isnan(run(n, x)).all(), n
    for n in ("RollingCorr", "RollingBeta", "RollingAlpha"):
        assert np.isnan(run(n, y, x)).all(), n
    assert (run("CCI", x, x, x) == 0).all() and (run("WilliamsR", x, x, x) == 0).all()
