"""Properties that every operator has: causality, missing rows, and one result however rows are cut."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidewater as tw
from tidewater.operators.kernels import Kernel
from tidewater.plans.node import expand, make
from tidewater.plans.registry import OPERATORS, REQUIRED

EXTRA = {"SchmittTrigger": {"lower": -0.5, "upper": 0.5}, "Hold": {"n": 3}, "SuperSmoother": {"period": 10.0}, "Decycler": {"period": 20.0}, "RoofingFilter": {"hp_period": 30.0, "lp_period": 8.0}, "RollingHurst": {"window_size": 32}}
SMALL = {"window_size": 5, "alpha": 0.3}
PUBLIC = sorted(n for n in OPERATORS if not n.startswith("_"))


def build(name):
    spec, p = OPERATORS[name], dict(EXTRA.get(name, {}))
    if name not in EXTRA:
        if {"com", "span", "halflife", "alpha"} <= set(spec.params):
            p["alpha"] = 0.3
        elif "window_size" in spec.params:
            p["window_size"] = 5
    return make(name, **p)


def rows(n=120, seed=3, missing=True):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({f"x{i}": rng.uniform(0.1, 0.9, n) for i in range(10)})
    if missing:
        for i in range(10):
            d.loc[rng.random(n) < 0.05, f"x{i}"] = np.nan
    d.insert(0, "i", np.arange(n))
    d.insert(0, "k", "a")
    return d


def compute(spark, frame, names):
    df = spark.createDataFrame(frame)
    outs = {}
    for n in names:
        op = build(n)
        node = op(*[f"x{i}" for i in range(op.spec.n_in)])
        outs.update({f"{n}_{j}": node[j] for j in range(len(op.spec.outputs))})
    return tw.series(df, "k", "i").select("i", **outs).orderBy("i").toPandas()


GROUPS = [PUBLIC[i : i + 60] for i in range(0, len(PUBLIC), 60)]


@pytest.mark.parametrize("names", GROUPS, ids=range(len(GROUPS)))
def test_causal_and_missing_rows_leave_no_trace(spark, names):
    base = rows()
    tampered = base.copy()
    tampered.loc[80:, [f"x{i}" for i in range(10)]] = tampered.loc[80:, [f"x{i}" for i in range(10)]] * 3 + 0.01
    # a row that is missing everywhere, in the middle
    gap = pd.concat([base.iloc[:50], base.iloc[[50]].assign(**{f"x{i}": np.nan for i in range(10)}), base.iloc[50:]]).reset_index(drop=True)
    gap["i"] = np.arange(len(gap))
    full, cut, holed = (compute(spark, f, names) for f in (base, tampered, gap))
    for c in full.columns[1:]:
        np.testing.assert_allclose(full[c][:80].astype(float), cut[c][:80].astype(float), rtol=1e-9, atol=1e-12, err_msg=f"{c} sees the future")
        spec = OPERATORS[c.rsplit("_", 1)[0]]
        positional = spec.policy != "ignore" or c.startswith(("Diff2", "BacktestOHLCTarget"))
        if not positional:
            assert pd.isna(holed[c][50]), c
            kept = holed[c].drop(50).reset_index(drop=True)
            np.testing.assert_allclose(full[c].astype(float), kept.astype(float), rtol=1e-7, atol=1e-9, err_msg=f"{c} remembers a missing row")


def kernels():
    for name in PUBLIC:
        try:
            n = expand(build(name)(*[f"x{i}" for i in range(OPERATORS[name].n_in)]))
        except IndexError:
            continue
        if n.spec is not None and n.spec.kind == "kernel":
            yield name, n


@pytest.mark.parametrize("name,node", list(kernels()), ids=lambda x: x if isinstance(x, str) else "")
def test_kernels_give_the_same_in_blocks(name, node):
    import pickle

    rng = np.random.default_rng(5)
    x = [rng.uniform(0.1, 0.9, 150) for _ in range(node.spec.n_in)]
    whole = node.spec.build(**node.params).block(*x)
    k, parts = node.spec.build(**node.params), []
    for s, e in ((0, 1), (1, 2), (2, 60), (60, 60), (60, 150)):
        parts.append(k.block(*[v[s:e] for v in x]))
        k = pickle.loads(pickle.dumps(k))
    for i, w in enumerate(whole):
        np.testing.assert_allclose(np.concatenate([p[i] for p in parts]), w, rtol=1e-9, atol=1e-12)
    assert isinstance(k, Kernel)


def test_keys_and_batches_do_not_mix(spark):
    frame = pd.concat([rows(seed=s, n=40 + s).assign(k=f"k{s}") for s in range(6)]).sample(frac=1, random_state=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = tw.series(spark.createDataFrame(frame), "k", "i").select("k", "i", e=tw.ops.EwMean(alpha=0.3)("x0"), m=tw.ops.RollingMean(4)("x0"), a=tw.ops.KAMA(3)("x0")).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, g in got.groupby("k"):
        alone = compute_one(frame[frame.k == key])
        g = g.sort_values("i").reset_index(drop=True)
        np.testing.assert_allclose(g.e.astype(float), alone, rtol=1e-9)


def compute_one(frame):
    x = frame.sort_values("i").x0.reset_index(drop=True)
    return x.ewm(alpha=0.3, ignore_na=True).mean().where(x.notna()).to_numpy()


def test_parameters_are_checked():
    with pytest.raises(TypeError):
        tw.ops.RollingMean(3, bogus=1)
    with pytest.raises(ValueError):
        tw.ops.RollingMean(0)
    with pytest.raises(ValueError):
        tw.ops.RollingMean(3, "lenient")
    with pytest.raises(ValueError):
        tw.ops.EwMean()
    with pytest.raises(ValueError):
        tw.ops.EwMean(span=3, alpha=0.5)
    with pytest.raises(TypeError):
        tw.ops.SchmittTrigger()
    with pytest.raises(AttributeError):
        tw.ops.NoSuch
    assert REQUIRED not in [p for s in OPERATORS.values() if s.name in EXTRA for p in build(s.name).params.values()]


def test_windows_with_one_spec_share_one_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 5).alias("k"), F.rand(1).alias("x"))
    out = tw.series(df, "k", "i").with_columns(a=tw.ops.RollingMean(3)("x"), b=tw.ops.RollingStd(3)("x"), c=tw.ops.CumSum()("x"), d=tw.ops.EwMean(alpha=0.2)("x")).df
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


MACROS = sorted(n for n in PUBLIC if OPERATORS[n].kind == "macro")


def test_every_macro_is_one_shuffle(spark):
    """Whatever an operator is made of, its rows are dealt out once."""
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 5).alias("k"), *[F.rand(j).alias(f"x{j}") for j in range(10)])
    s = tw.series(df, "k", "i")
    many = {}
    for n in MACROS:
        op = build(n)
        node = op(*[f"x{i}" for i in range(op.spec.n_in)])
        many[n] = s.select("i", **{f"o{j}": node[j] for j in range(len(op.spec.outputs))})._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert len(many) > 40 and {n: c for n, c in many.items() if c != 1} == {}


def test_chained_graphs_are_one_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 5).alias("k"), F.rand(1).alias("x"))
    x = "x"
    for _ in range(4):
        x = tw.ops.RollingMean(30)(tw.ops.EwMean(alpha=0.2)(x))
    nodes = {"a": x, "b": tw.ops.Sub()(x, tw.ops.RollingMax(5)(tw.ops.EwStd(alpha=0.1)("x"))), "c": tw.ops.CumSum()("x")}
    plan = tw.series(df, "k", "i").select("i", **nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1, plan


def test_ported_forms_equal_their_operators(spark):
    """What follows a kernel gives there what it gives over a plain column."""
    from tidewater.operators.chains import PORTABLE

    frame = rows(90, seed=9)
    first = tw.series(spark.createDataFrame(frame), "k", "i").with_columns(**{f"e{i}": tw.ops.EwMean(alpha=0.5)(f"x{i}") for i in range(4)})
    settled = tw.series(spark.createDataFrame(first.df.toPandas()), "k", "i")
    direct, behind = {}, {}
    for n in PORTABLE:
        spec = OPERATORS[n]
        p = {"taps": (0.5, 0.3, 0.2)} if n == "MovingAverage" else {"window_size": 6} if "window_size" in spec.params else {"n": 3} if "n" in spec.params else {}
        op = make(n, **p)
        for j in range(len(spec.outputs)):
            name = f"{n.lower()}_{j}"
            direct[name] = op(*[f"e{i}" for i in range(spec.n_in)])[j]
            # a kernel on top keeps the operator within the pass
            behind[name] = make("Cube")(make("EwMean", alpha=1.0)(op(*[tw.ops.EwMean(alpha=0.5)(f"x{i}") for i in range(spec.n_in)])[j]))
    want = settled.select("i", **direct).orderBy("i").toPandas()
    got = tw.series(spark.createDataFrame(frame), "k", "i").select("i", **behind).orderBy("i").toPandas()
    for c in direct:
        np.testing.assert_allclose(np.cbrt(got[c].astype(float)), want[c].astype(float), rtol=1e-6, atol=1e-7, err_msg=c)


def test_infinities_and_logs(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, -1.0, 1.0, math.inf, float("nan"), None])], "i int, x double")
    got = [r for r in tw.series(df, (), "i").select("i", l=tw.ops.Log()("x"), d=tw.ops.Div()("x", "i"), n=tw.ops.IsNan()("x"), f=tw.ops.IsFinite()("x")).orderBy("i").collect()]
    assert [r.l for r in got] == [-math.inf, None, 0.0, math.inf, None, None]
    assert [r.n for r in got] == [0, 0, 0, 0, 1, 1] and [r.f for r in got] == [1, 1, 1, 0, 0, 0]
    assert got[0].d is None and got[1].d == -1.0


@pytest.mark.parametrize("names", GROUPS, ids=range(len(GROUPS)))
@pytest.mark.parametrize("case", ["constant", "zero", "missing", "one", "none"])
def test_degenerate_series(spark, names, case):
    f = rows(40, missing=False)
    cols = [f"x{i}" for i in range(10)]
    if case in ("constant", "zero"):
        f[cols] = 0.0 if case == "zero" else 0.5
    elif case == "missing":
        f[cols] = np.nan
    elif case == "one":
        f = f.iloc[:1]
    df = spark.createDataFrame(f)
    outs = {}
    for n in names:
        op = build(n)
        node = op(*cols[: op.spec.n_in])
        outs.update({f"{n}_{j}": node[j] for j in range(len(op.spec.outputs))})
    got = tw.series(df.limit(0) if case == "none" else df, "k", "i").select("i", **outs).toPandas()
    assert len(got) == (0 if case == "none" else len(f))


def test_series_in_pieces(spark):
    frame = pd.concat([rows(seed=1, n=900).assign(k="hot"), rows(seed=2, n=40).assign(k="a"), rows(seed=3, n=5).assign(k="z"), rows(seed=4, n=60).assign(k="zz")])
    s = tw.series(spark.createDataFrame(frame), "k", "i")
    nodes = {"m": tw.ops.RollingMean(5)("x0"), "s": tw.ops.RollingStd(20)("x1"), "d": tw.ops.RollingResidualStd(6)("x0", "x1"), "l": tw.ops.Lag(3)("x2"), "r": tw.ops.RollingRank(8)("x3")}
    want = s.select("k", "i", **nodes).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    for memory, partitions in ((40, 7), (60, 300), (60, 1)):
        got = s.in_pieces(memory, partitions, **nodes)
        assert len(got.columns) == len(s.df.columns) + len(nodes)
        got = got.toPandas().sort_values(["k", "i"]).reset_index(drop=True)
        assert len(got) == len(want)
        for c in nodes:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-9, err_msg=c)
    for bad in (tw.ops.CumSum()("x0"), tw.ops.EwMean(alpha=0.1)("x0"), tw.ops.ExpandingSlope()("x0"), tw.ops.Ffill()("x0")):
        with pytest.raises(ValueError):
            s.in_pieces(10, 3, b=bad)
