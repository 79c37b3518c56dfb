"""One query for each operator, over series made from the events table, with the SQL that gives the same result.

The SQL runs in stages. A stage has a validity condition, by which rows are partitioned beside the key, and columns;
`{w10}` stands for the frame of the last 10 valid rows, `{u}` for all so far, `{s}` for the valid rows in order, `{t}` for
all rows in order, `{n}` for the number of the valid row."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators  # noqa: F401
from .frame import series
from .plans.node import Node, Operator, make

Query = Callable[[SparkSession, str], DataFrame]

#: Columns of the series, in SQL that both engines read alike.
COLUMNS = {
    "event_id": "event_id",
    "user_id": "user_id",
    "ts": "ts",
    "x": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END",
    "y": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value * 0.25e0 + (event_id % 7) END",
    "z": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value - 40e0 END",
    "u": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE ((event_id * 7) % 21 - 10) / 10e0 END",
    "r": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE ((event_id * 31) % 41 - 20) / 500e0 END",
    "g": "((event_id * 17) % 29 - 14) / 600e0",
    "a": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id * 5 % 3 + 0e0 END",
    "b": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id * 7 % 4 % 3 + 0e0 END",
    "o": "100e0 + (event_id * 7) % 13",
    "h": "114e0 + (event_id * 5) % 7",
    "l": "98e0 - (event_id * 3) % 5",
    "c": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 100e0 + (event_id * 11) % 14 END",
    "v": "10e0 + (event_id * 29) % 101",
    "p": "100e0 + ((event_id * 37) % 101) / 8e0",
    "q": "100e0 + ((event_id * 13) % 97) / 8e0",
    "mb": "99e0 + ((event_id * 13) % 97) / 8e0",
    "ma": "102e0 + ((event_id * 13) % 97) / 8e0",
}
_BASE = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM events"


def frame(spark: SparkSession, sf_dir: str):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return series(events.selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()]), key="user_id", order=["ts", "event_id"])


def tidy(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Rounded, so that two engines' last digits agree; a small shift keeps decimal data off the halves."""
    return df.select(*[c for c in df.columns if c not in names], *[(F.round(F.col(n) + F.lit(_shift(digits)), digits) + F.lit(0.0)).alias(n) for n in names])


def _shift(digits: int) -> float:
    return 3.7 * 10.0 ** -(digits + 2)


def _sql(stages: list[tuple[str, dict[str, str]]], outputs: dict[str, str], digits: int = 6) -> str:
    with_, last = [f"s0 AS ({_BASE})"], "s0"
    for i, (valid, cols) in enumerate(stages, 1):
        order = "ORDER BY ts, event_id"
        part = "PARTITION BY user_id, ok"

        def put(e: str) -> str:
            e = e.replace("{n}", "row_number() {s}").replace("{s}", f"OVER ({part} {order})").replace("{t}", f"OVER (PARTITION BY user_id {order})")
            e = e.replace("{u}", f"OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").replace("{a}", f"OVER (PARTITION BY user_id {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
            return re.sub(r"\{w(\d+)\}", lambda m: f"OVER ({part} {order} ROWS BETWEEN {int(m[1]) - 1} PRECEDING AND CURRENT ROW)", e)

        made = ", ".join(f"CASE WHEN ok THEN {put(e)} END AS {n}" for n, e in cols.items())
        keep = ", ".join(dict.fromkeys([*COLUMNS, *(n for _, c in stages[: i - 1] for n in c)]))
        with_.append(f"s{i} AS (SELECT {keep}, {made} FROM (SELECT *, ({valid}) AS ok FROM {last}))")
        last = f"s{i}"
    out = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE round({c} + {_shift(digits)!r}::DOUBLE, {digits}) + 0e0 END AS {n}" for n, c in outputs.items())
    return f"WITH {', '.join(with_)} SELECT event_id, {out} FROM {last}"


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def there(columns: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns.split())


def snake(name: str) -> str:
    name = name.replace("CVaR", "Cvar")
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def configured(call: str) -> Operator:
    """The operator that a call with literal parameters names."""
    tree = ast.parse(call, mode="eval").body
    value = lambda e: math.inf * (-1 if isinstance(e, ast.UnaryOp) else 1) if ast.unparse(e) in ("inf", "-inf") else ast.literal_eval(e)
    return make(tree.func.id, *map(value, tree.args), **{k.arg: value(k.value) for k in tree.keywords})


def add(call: str, columns: str, sql: str | dict[str, str] | list | None = None, valid: str | None = None, digits: int = 6, key: str | None = None, **final: str) -> None:
    """Registers the query of an operator: its call, its inputs, and SQL for its outputs (a dict, for several; a list of
    stages, for stacked windows; None where SQL can't express it). `final` names the SQL column of an output where it has
    another name."""
    op = configured(call)
    key = key or snake(op.spec.name)
    while key in QUERIES:
        key += "_2"
    outs = [o or "out" for o in op.spec.outputs]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        node: Node = op(*columns.split())
        return tidy(frame(spark, sf_dir).select("event_id", **{o: node[i] for i, o in enumerate(outs)}), outs, digits)

    query.__doc__ = f"{call} of {columns}"
    QUERIES[key] = query
    if sql is None:
        return
    valid = there(columns) if valid is None else valid
    if isinstance(sql, str):
        sql = {outs[0]: sql}
    stages = sql if isinstance(sql, list) else [(valid, sql)]
    ORACLES[key] = _sql(stages, {o: final.get(o, o) for o in outs}, digits)


# -- elementwise -------------------------------------------------------------------------------------------------------

for _call, _c, _e in (
    ("Abs()", "z", "abs(z)"), ("Log()", "z", "CASE WHEN z > 0 THEN ln(z) WHEN z = 0 THEN -('infinity'::DOUBLE) END"), ("Exp()", "u", "exp(u)"), ("Sqrt()", "z", "CASE WHEN z >= 0 THEN sqrt(z) END"),
    ("Sign()", "u", "sign(u)"), ("Tanh()", "u", "tanh(u)"), ("Relu()", "u", "greatest(u, 0)"), ("PosPart()", "u", "greatest(u, 0)"), ("NegPart()", "u", "greatest(-u, 0)"),
    ("Selu()", "u", "CASE WHEN u > 0 THEN 1.0507e0 * u ELSE 1.0507e0 * 1.67326e0 * (exp(u) - 1) END"), ("Elu()", "u", "CASE WHEN u > 0 THEN u ELSE exp(u) - 1 END"), ("Softsign()", "u", "u / (1 + abs(u))"), ("Sigmoid()", "u", "1 / (1 + exp(-u))"),
    ("Linear(2.0, -1.0)", "x", "2 * x - 1"), ("Power(3.0)", "u", "pow(u, 3)"), ("Floor()", "z", "floor(z)"), ("Ceil()", "z", "ceil(z)"), ("Square()", "x", "x * x"), ("Cube()", "u", "u * u * u"),
    ("Sin()", "u", "sin(u)"), ("Cos()", "u", "cos(u)"), ("Atan()", "u", "atan(u)"), ("Asin()", "u", "asin(u)"), ("Acos()", "u", "acos(u)"), ("Round()", "z", "round_even(z, 0)"), ("Identity()", "x", "x"), ("Not()", "a", "CASE WHEN a <> 0 THEN 0e0 ELSE 1e0 END"),
    ("Linear2(2.0, -0.5, 3.0)", "x y", "2 * x - 0.5e0 * y + 3"), ("Hypot()", "x y", "sqrt(x * x + y * y)"), ("Atan2()", "z y", "atan2(z, y)"), ("Add()", "x y", "x + y"), ("Sub()", "x y", "x - y"), ("Mul()", "x y", "x * y"),
    ("Div()", "z a", "CASE WHEN a <> 0 THEN z / a WHEN z > 0 THEN 'infinity'::DOUBLE WHEN z < 0 THEN -('infinity'::DOUBLE) END"),
    ("GreaterThan()", "a b", "(a > b)::INT"), ("LessThan()", "a b", "(a < b)::INT"), ("GreaterEqual()", "a b", "(a >= b)::INT"), ("LessEqual()", "a b", "(a <= b)::INT"), ("Equal()", "a b", "(a = b)::INT"), ("NotEqual()", "a b", "(a <> b)::INT"),
    ("And()", "a b", "(a <> 0 AND b <> 0)::INT"), ("Or()", "a b", "(a <> 0 OR b <> 0)::INT"), ("OFI()", "a b", "CASE WHEN a + b = 0 THEN 0 ELSE (a - b) / (a + b) END"), ("QueueImbalance()", "a b", "CASE WHEN a + b = 0 THEN 0 ELSE (a - b) / (a + b) END"),
    ("EffectiveSpread()", "x y", "2 * abs(x - y)"), ("SignedVolume()", "u v", "u * v"), ("Clip(lower=5.0, upper=60.0)", "x", "least(greatest(x, 5), 60)"),
    ("BOP()", "o h l c", "CASE WHEN h > l THEN (c - o) / (h - l) ELSE 0 END"), ("MicroPrice()", "l h a b", "CASE WHEN a + b = 0 THEN (l + h) / 2 ELSE a / (a + b) * h + (1 - a / (a + b)) * l END"),
):
    add(_call, _c, _e)
add("Erf()", "u")
add("Erfc()", "u")
add("Cart2Polar()", "z y", {"rad": "sqrt(z * z + y * y)", "theta": "atan2(y, z)"}, r="rad")
add("Polar2Cart()", "x u", {"px": "x * cos(u)", "py": "x * sin(u)"}, x="px", y="py")
add("Where()", "a x y", "CASE WHEN a <> 0 THEN x WHEN a = 0 THEN y END", "true")
add("IsNan()", "x", "(x IS NULL)::INT", "true")
add("IsFinite()", "x", "(x IS NOT NULL)::INT", "true")
add("FillNa(-1.0)", "x", "coalesce(x, -1)", "true")

# -- positional, cumulative, expanding -----------------------------------------------------------------------------------

for _call, _c, _e in (
    ("Lag(3)", "x", "lag(x, 3) {t}"), ("Diff(2)", "x", "x - lag(x, 2) {t}"), ("Momentum(5)", "x", "x - lag(x, 5) {t}"), ("Diff2()", "x", "x - 2 * lag(x, 1) {t} + lag(x, 2) {t}"),
    ("Return(2)", "x", "x / lag(x, 2) {t} - 1"), ("ROCP(3)", "x", "x / lag(x, 3) {t} - 1"), ("ROC(3)", "x", "100 * (x / lag(x, 3) {t} - 1)"), ("ROCR(3)", "x", "x / lag(x, 3) {t}"), ("LogReturn()", "x", "ln(x / lag(x, 1) {t})"),
    ("Ffill()", "x", "last_value(x IGNORE NULLS) {a}"),
    ("Lag(2, 'zero')", "x", "CASE WHEN row_number() {t} <= 2 THEN 0 ELSE lag(x, 2) {t} END"), ("Diff(2, 'expanding')", "x", "x - CASE WHEN row_number() {t} <= 2 THEN first_value(x) {a} ELSE lag(x, 2) {t} END"),
    ("Propagator(4, 2.0, 0.5)", "x", "2 * x + 2 * pow(2, -0.5e0) * lag(x, 1) {t} + 2 * pow(3, -0.5e0) * lag(x, 2) {t} + 2 * pow(4, -0.5e0) * lag(x, 3) {t}"),
):
    add(_call, _c, _e, "true")
for _call, _c, _e in (
    ("CumSum()", "x", "sum(x) {u}"), ("ExpandingSum()", "y", "sum(y) {u}"), ("CumMax()", "x", "max(x) {u}"), ("CumMin()", "x", "min(x) {u}"), ("ExpandingMax()", "y", "max(y) {u}"), ("ExpandingMin()", "y", "min(y) {u}"),
    ("ExpandingMean()", "x", "avg(x) {u}"), ("ExpandingVar()", "x", "var_samp(x) {u}"), ("ExpandingStd()", "x", "stddev_samp(x) {u}"), ("ExpandingSkew()", "x", "CASE WHEN {n} >= 3 THEN skewness(x) {u} END"), ("ExpandingKurt()", "x", "CASE WHEN {n} >= 4 THEN kurtosis(x) {u} END"),
    ("First()", "x", "first_value(x) {u}"), ("Last()", "x", "x"), ("Drawdown()", "x", "x / max(x) {u} - 1"),
    ("SchmittTrigger(20.0, 60.0)", "x", "coalesce(last_value(CASE WHEN x > 60 THEN 1e0 WHEN x < 20 THEN 0e0 END IGNORE NULLS) {u}, 0)"), ("Hold(3, -1.0)", "a", "coalesce(last_value(CASE WHEN a <> 0 THEN a END IGNORE NULLS) {w3}, -1)"),
    ("MovingAverage((0.5, 0.3, 0.2))", "x", "0.5e0 * x + 0.3e0 * lag(x, 1) {s} + 0.2e0 * lag(x, 2) {s}"),
):
    add(_call, _c, _e)
for _n in ("CumProd", "ExpandingProd"):
    add(f"{_n}()", "a", "product(a) {u}")
add("MaxDrawdown()", "x", [(there("x"), {"d": "x / max(x) {u} - 1"}), (there("d"), {"out": "min(d) {u}"})])
add("ExpandingSlope()", "x", [(there("x"), {"n": "{n}"}), (there("x"), {"out": "CASE WHEN n >= 2 THEN regr_slope(x, n) {u} END"})])

# -- rolling -----------------------------------------------------------------------------------------------------------------

G = "CASE WHEN {n} >= 10 THEN "
for _call, _c, _e in (
    ("RollingMean(10)", "x", G + "avg(x) {w10} END"), ("RollingMean(10, 'expanding')", "x", "avg(x) {w10}"), ("RollingMean(10, 'zero')", "x", "sum(x) {w10} / 10"), ("RollingSum(10)", "x", G + "sum(x) {w10} END"), ("RollingOrderImbalance(10)", "u", None),
    ("RollingVar(10)", "x", G + "var_samp(x) {w10} END"), ("RollingVar(10, 'zero')", "x", "(sum(x * x) {w10} - pow(sum(x) {w10}, 2) / 10) / 9"), ("RollingStd(10)", "x", G + "stddev_samp(x) {w10} END"), ("RollingRms(10)", "x", G + "sqrt(avg(x * x) {w10}) END"),
    ("RollingSkew(10)", "x", G + "skewness(x) {w10} END"), ("RollingKurt(10)", "x", G + "kurtosis(x) {w10} END"), ("RollingZscore(10)", "x", G + "(x - avg(x) {w10}) / stddev_samp(x) {w10} END"), ("Detrend(10)", "x", "x - " + G + "avg(x) {w10} END"),
    ("RollingMin(10)", "x", "min(x) {w10}"), ("RollingMax(10)", "x", "max(x) {w10}"), ("RollingRange(10)", "x", "max(x) {w10} - min(x) {w10}"), ("RollingMedian(10)", "x", "median(x) {w10}"), ("RollingQuantile(10, 0.3)", "x", G + "quantile_cont(x, 0.3) {w10} END"),
    ("RollingIqr(10)", "x", G + "quantile_cont(x, 0.75) {w10} - quantile_cont(x, 0.25) {w10} END"), ("RollingMedianAD(10)", "x", G + "mad(x) {w10} END"), ("RollingHitRate(10)", "r", G + "avg((r > 0)::INT) {w10} END"),
    ("RollingSharpe(10, 252.0)", "r", G + "sqrt(252) * avg(r) {w10} / nullif(stddev_samp(r) {w10}, 0) END"), ("RollingSortino(10, 252.0, 0.001)", "r", G + "sqrt(252) * (avg(r) {w10} - 0.001e0) / nullif(sqrt(avg(pow(least(r - 0.001e0, 0), 2)) {w10}), 0) END"),
    ("RollingInfoRatio(10)", "r g", G + "avg(r - g) {w10} / nullif(stddev_samp(r - g) {w10}, 0) END"), ("RollingDownsideDeviation(10, 0.01)", "r", G + "sqrt(avg(pow(least(r - 0.01e0, 0), 2)) {w10}) END"), ("RollingOmega(10, 0.001)", "r", G + "sum(greatest(r - 0.001e0, 0)) {w10} / nullif(sum(greatest(0.001e0 - r, 0)) {w10}, 0) END"),
    ("RollingCorr(10)", "x y", G + "corr(x, y) {w10} END"), ("RollingCov(10)", "x y", G + "covar_samp(x, y) {w10} END"), ("RollingBeta(10)", "x y", G + "regr_slope(x, y) {w10} END"), ("RollingKyleLambda(10)", "y x", G + "regr_slope(x, y) {w10} END"), ("RollingSpread(10)", "x y", G + "x - regr_slope(x, y) {w10} * y END"), ("RollingAlpha(10)", "x y", G + "regr_intercept(x, y) {w10} END"),
    ("WilliamsR(10)", "h l c", G + "-100 * (max(h) {w10} - c) / (max(h) {w10} - min(l) {w10}) END"), ("RealizedSpread(2)", "p q", "2 * lag(sign(p - q), 2) {s} * (lag(p, 2) {s} - q)"),
    ("TrueRange()", "h l c", "greatest(h - l, abs(h - lag(c) {s}), abs(l - lag(c) {s})) + 0 * lag(c) {s}"), ("RollingVWAP(10)", "h l c v", G + "sum((h + l + c) / 3 * v) {w10} / sum(v) {w10} END"), ("AD()", "h l c v", "sum(CASE WHEN h > l THEN ((c - l) - (h - c)) / (h - l) * v ELSE 0 END) {u}"),
):
    add(_call, _c, _e if _e is not None else G + "sum(u) {w10} END")


def _listed(call: str, column: str, sql: str, gate: bool = True, k: int = 10, key: str | None = None) -> None:
    """SQL over `vv`, the list of the frame's values, oldest first."""
    add(call, column, [(there(column), {"vv": f"list({column}) {{w{k}}}"}), (there(column), {"out": f"CASE WHEN len(vv) >= {k} THEN {sql} END" if gate else sql})], key=key)


_listed("RollingArgmax(10)", "a", "len(vv) - list_position(list_reverse(vv), list_max(vv))", gate=False)
_listed("RollingArgmin(10)", "a", "len(vv) - list_position(list_reverse(vv), list_min(vv))", gate=False)
_listed("RollingMad(10)", "x", "list_avg([abs(e - list_avg(vv)) for e in vv])")
_listed("RollingRank(10)", "a", "len([e for e in vv if e < a]) + (len([e for e in vv if e = a]) + 1) / 2e0")
_listed("RollingPercentile(10)", "a", "(len([e for e in vv if e < a]) + (len([e for e in vv if e = a]) + 1) / 2e0) / 10")
_listed("RollingCVaR(10, 0.25)", "r", "-list_avg(list_sort(vv)[1:2])")
_listed("WMA(10)", "x", "list_sum([vv[i] * i for i in range(1, 11)]) / 55")
_listed("RollingPoly1(10, 1)", "x", "(10 * list_sum([vv[i] * i for i in range(1, 11)]) - 55 * list_sum(vv)) / 825")
_listed("RollingPoly1(10)", "x", "list_avg(vv) + 4.5e0 * (10 * list_sum([vv[i] * i for i in range(1, 11)]) - 55 * list_sum(vv)) / 825")
_listed("RollingTSF(10)", "x", "list_avg(vv) + 5.5e0 * (10 * list_sum([vv[i] * i for i in range(1, 11)]) - 55 * list_sum(vv)) / 825")
_listed("RollingPoly2(10, 2)", "x", "2 * list_sum([vv[i] * (pow(i - 5.5e0, 2) - 8.25e0) for i in range(1, 11)]) / 528")
_listed("RollingMaxDrawdown(10)", "p", "list_min([vv[i] / list_max(vv[1:i]) - 1 for i in range(1, 11)])")
_listed("FracDiff(0.4, 8, 1e-5)", "x", "list_sum([vv[9 - i] * ([1, -0.4e0, -0.12e0, -0.064e0, -0.0416e0, -0.029952e0, -0.0229632e0, -0.01837056e0])[i] for i in range(1, 9)])", k=8)
add("RollingMinMax(10)", "x", {"min": "min(x) {w10}", "max": "max(x) {w10}"})
add("BollingerBands(10)", "x", {"lower": G + "avg(x) {w10} - 2 * stddev_samp(x) {w10} END", "mid": G + "avg(x) {w10} END", "upper": G + "avg(x) {w10} + 2 * stddev_samp(x) {w10} END"})
add("DonchianChannels(10)", "h l", {"lower": G + "min(l) {w10} END", "mid": G + "(min(l) {w10} + max(h) {w10}) / 2 END", "upper": G + "max(h) {w10} END"})
add("RollingLinearRegression(10)", "x y", {"slope": G + "regr_slope(x, y) {w10} END", "intercept": G + "regr_intercept(x, y) {w10} END", "r2": G + "regr_r2(x, y) {w10} END", "stderr": G + "sqrt(greatest(regr_syy(x, y) {w10} - pow(regr_sxy(x, y) {w10}, 2) / regr_sxx(x, y) {w10}, 0) / 8) END"})
add("RollingResidualStd(10)", "x y", [(there("x y"), {"d": G + "x - regr_slope(x, y) {w10} * y END"}), (there("d"), {"out": G + "stddev_samp(d) {w10} END"})])
add("RollingCalmar(10, 252.0)", "r", [(there("r"), {"e": "product(1 + r) {u}"}), (there("r"), {"l10": "list(e) {w10}", "m": G + "avg(r) {w10} END"}), (there("m"), {"out": "252 * m / nullif(round(abs(list_min([l10[i] / list_max(l10[1:i]) - 1 for i in range(1, 11)])), 12), 0)"})])
add("RollingOU(10)", "x", [(there("x"), {"d": "coalesce(lag(x) {s}, 0)"}), (there("x"), {"sy": "sum(x) {w9}", "sxy": "sum(d * x) {w9}", "syy": "sum(x * x) {w9}", "i": "{n}"}), (there("x"), {"sx": "lag(sy) {s}", "sxx": "lag(syy) {s}"}), (there("x"), {"out": "CASE WHEN i >= 10 THEN 1 - (9 * sxy - sx * sy) / nullif(9 * sxx - sx * sx, 0) END"})])
add("TRIMA(7)", "x", [(there("x"), {"m": "avg(x) {w4}"}), (there("m"), {"out": "CASE WHEN {n} >= 7 THEN avg(m) {w4} END"})])
add("HullMA(9)", "x", [(there("x"), {"l4": "list(x) {w4}", "l9": "list(x) {w9}"}), (there("x"), {"d": "2 * list_sum([l4[i] * i for i in range(1, len(l4) + 1)]) / (len(l4) * (len(l4) + 1) / 2) - list_sum([l9[i] * i for i in range(1, len(l9) + 1)]) / (len(l9) * (len(l9) + 1) / 2)"}), (there("d"), {"out": "CASE WHEN {n} >= 11 THEN (3 * d + 2 * lag(d) {s} + lag(d, 2) {s}) / 6 END"})])

# -- the same at window 20, and other start policies: block forms --------------------------------------------------------------


def _taps(d: float, k: int) -> list[float]:
    out = [1.0]
    for i in range(1, k):
        out.append(out[-1] * (i - 1 - d) / i)
    return out


G20 = "CASE WHEN {n} >= 20 THEN "
_SLOPE = "(20 * list_sum([vv[i] * i for i in range(1, 21)]) - 210 * list_sum(vv)) / 13300"
_DOWN = "sqrt(avg(pow(least(r - 0.01e0, 0), 2)) {w20})"
_TWENTY = (
    ("RollingMean(20)", "x", "avg(x) {w20}"), ("RollingSum(20)", "x", "sum(x) {w20}"), ("RollingOrderImbalance(20)", "u", "sum(u) {w20}"), ("RollingVar(20)", "x", "var_samp(x) {w20}"), ("RollingStd(20)", "x", "stddev_samp(x) {w20}"),
    ("RollingRms(20)", "x", "sqrt(avg(x * x) {w20})"), ("RollingSkew(20)", "x", "skewness(x) {w20}"), ("RollingKurt(20)", "x", "kurtosis(x) {w20}"), ("RollingZscore(20)", "x", "(x - avg(x) {w20}) / stddev_samp(x) {w20}"), ("Detrend(20)", "x", "x - avg(x) {w20}"),
    ("RollingQuantile(20, 0.3)", "x", "quantile_cont(x, 0.3) {w20}"), ("RollingIqr(20)", "x", "quantile_cont(x, 0.75) {w20} - quantile_cont(x, 0.25) {w20}"), ("RollingMedianAD(20)", "x", "mad(x) {w20}"), ("RollingHitRate(20)", "r", "avg((r > 0)::INT) {w20}"),
    ("RollingSharpe(20, 252.0)", "r", "sqrt(252) * avg(r) {w20} / nullif(stddev_samp(r) {w20}, 0)"), ("RollingSortino(20, 252.0, 0.001)", "r", "sqrt(252) * (avg(r) {w20} - 0.001e0) / nullif(sqrt(avg(pow(least(r - 0.001e0, 0), 2)) {w20}), 0)"),
    ("RollingInfoRatio(20)", "r g", "avg(r - g) {w20} / nullif(stddev_samp(r - g) {w20}, 0)"), ("RollingDownsideDeviation(20, 0.01)", "r", _DOWN), ("RollingOmega(20, 0.001)", "r", "sum(greatest(r - 0.001e0, 0)) {w20} / nullif(sum(greatest(0.001e0 - r, 0)) {w20}, 0)"),
    ("RollingCorr(20)", "x y", "corr(x, y) {w20}"), ("RollingCov(20)", "x y", "covar_samp(x, y) {w20}"), ("RollingBeta(20)", "x y", "regr_slope(x, y) {w20}"), ("RollingKyleLambda(20)", "y x", "regr_slope(x, y) {w20}"),
    ("RollingSpread(20)", "x y", "x - regr_slope(x, y) {w20} * y"), ("RollingAlpha(20)", "x y", "regr_intercept(x, y) {w20}"),
    ("WilliamsR(20)", "h l c", "-100 * (max(h) {w20} - c) / (max(h) {w20} - min(l) {w20})"), ("RollingVWAP(20)", "h l c v", "sum((h + l + c) / 3 * v) {w20} / sum(v) {w20}"),
)
for _call, _c, _e in _TWENTY:
    add(_call, _c, f"{G20}{_e} END", key=f"{snake(_call.split('(')[0])}_20")
for _call, _c, _e in (("RollingMin(20)", "x", "min(x) {w20}"), ("RollingMax(20)", "x", "max(x) {w20}"), ("RollingRange(20)", "x", "max(x) {w20} - min(x) {w20}"), ("RollingMedian(20)", "x", "median(x) {w20}")):
    add(_call, _c, _e, key=f"{snake(_call.split('(')[0])}_20")
for _n, _c, _e in (
    ("RollingMean", "x", "avg(x) {w20}"), ("RollingSum", "x", "sum(x) {w20}"), ("RollingVar", "x", "var_samp(x) {w20}"), ("RollingStd", "x", "stddev_samp(x) {w20}"), ("RollingRms", "x", "sqrt(avg(x * x) {w20})"), ("Detrend", "x", "x - avg(x) {w20}"),
    ("RollingSkew", "x", "CASE WHEN {n} >= 3 THEN skewness(x) {w20} END"), ("RollingKurt", "x", "CASE WHEN {n} >= 4 THEN kurtosis(x) {w20} END"), ("RollingMedianAD", "x", "mad(x) {w20}"), ("RollingCorr", "x y", "CASE WHEN {n} >= 2 THEN corr(x, y) {w20} END"), ("RollingCov", "x y", "CASE WHEN {n} >= 2 THEN covar_samp(x, y) {w20} END"),
    ("RollingBeta", "x y", "CASE WHEN {n} >= 2 THEN regr_slope(x, y) {w20} END"),
):
    add(f"{_n}(20, 'expanding')", _c, _e, key=f"{snake(_n)}_20_expanding")
_V0, _C0 = "(sum(x * x) {w20} - pow(sum(x) {w20}, 2) / 20) / 19", "(sum(x * y) {w20} - sum(x) {w20} * sum(y) {w20} / 20)"
for _n, _c, _e in (
    ("RollingMean", "x", "sum(x) {w20} / 20"), ("RollingSum", "x", "sum(x) {w20}"), ("RollingVar", "x", _V0), ("RollingStd", "x", f"sqrt(greatest({_V0}, 0))"), ("RollingRms", "x", "sqrt(sum(x * x) {w20} / 20)"), ("Detrend", "x", "x - sum(x) {w20} / 20"),
    ("RollingCov", "x y", f"{_C0} / 19"), ("RollingBeta", "x y", f"{_C0} / nullif(sum(y * y) {{w20}} - pow(sum(y) {{w20}}, 2) / 20, 0)"),
):
    add(f"{_n}(20, 'zero')", _c, _e, key=f"{snake(_n)}_20_zero")
for _call, _c, _e, _gate in (
    ("RollingArgmax(20)", "a", "len(vv) - list_position(list_reverse(vv), list_max(vv))", False), ("RollingArgmin(20)", "a", "len(vv) - list_position(list_reverse(vv), list_min(vv))", False),
    ("RollingMad(20)", "x", "list_avg([abs(e - list_avg(vv)) for e in vv])", True), ("RollingRank(20)", "a", "len([e for e in vv if e < a]) + (len([e for e in vv if e = a]) + 1) / 2e0", True),
    ("RollingPercentile(20)", "a", "(len([e for e in vv if e < a]) + (len([e for e in vv if e = a]) + 1) / 2e0) / 20", True), ("RollingCVaR(20, 0.25)", "r", "-list_avg(list_sort(vv)[1:5])", True), ("WMA(20)", "x", "list_sum([vv[i] * i for i in range(1, 21)]) / 210", True),
    ("RollingPoly1(20, 1)", "x", _SLOPE, True), ("RollingTSF(20)", "x", f"list_avg(vv) + 10.5e0 * {_SLOPE}", True), ("RollingPoly2(20, 2)", "x", "2 * list_sum([vv[i] * (pow(i - 10.5e0, 2) - 33.25e0) for i in range(1, 21)]) / 17556", True),
    ("RollingMaxDrawdown(20)", "p", "list_min([vv[i] / list_max(vv[1:i]) - 1 for i in range(1, 21)])", True), ("FracDiff(0.4, 20, 1e-9)", "x", f"list_sum([vv[21 - i] * ({_taps(0.4, 20)!r}::DOUBLE[])[i] for i in range(1, 21)])", True),
):
    _listed(_call, _c, _e, _gate, 20, f"{snake(_call.split('(')[0])}_20")
add("RollingMinMax(20)", "x", {"min": "min(x) {w20}", "max": "max(x) {w20}"}, key="rolling_min_max_20")
add("BollingerBands()", "x", {"lower": G20 + "avg(x) {w20} - 2 * stddev_samp(x) {w20} END", "mid": G20 + "avg(x) {w20} END", "upper": G20 + "avg(x) {w20} + 2 * stddev_samp(x) {w20} END"}, key="bollinger_bands_20")
add("DonchianChannels(20)", "h l", {"lower": G20 + "min(l) {w20} END", "mid": G20 + "(min(l) {w20} + max(h) {w20}) / 2 END", "upper": G20 + "max(h) {w20} END"}, key="donchian_channels_20")
add("RollingLinearRegression(20)", "x y", {"slope": G20 + "regr_slope(x, y) {w20} END", "intercept": G20 + "regr_intercept(x, y) {w20} END", "r2": G20 + "regr_r2(x, y) {w20} END", "stderr": G20 + "sqrt(greatest(regr_syy(x, y) {w20} - pow(regr_sxy(x, y) {w20}, 2) / regr_sxx(x, y) {w20}, 0) / 18) END"}, key="rolling_linear_regression_20")
_DEV = "list_avg([abs(e - list_avg(v20)) for e in v20])"
add("CCI(20)", "h l c", [(there("h l c"), {"w": "(h + l + c) / 3"}), (there("w"), {"v20": "list(w) {w20}"}), (there("w"), {"out": f"CASE WHEN len(v20) >= 20 THEN CASE WHEN {_DEV} > 0 THEN (w - list_avg(v20)) / (0.015e0 * {_DEV}) ELSE 0 END END"})], key="cci_20")

# -- oscillators, ranges, volume -----------------------------------------------------------------------------------------------

add("RollingRSI(10, 'cutler')", "x", [(there("x"), {"d": "coalesce(x - lag(x) {s}, 0)"}), (there("d"), {"out": G + "100 * sum(greatest(d, 0)) {w10} / nullif(sum(abs(d)) {w10}, 0) END"})])
_K = "CASE WHEN {n} >= 10 THEN 100 * (c - min(l) {w10}) / (max(h) {w10} - min(l) {w10}) END"
add("Stoch(10, 3, 3)", "h l c", [(there("h l c"), {"f": _K}), (there("f"), {"kk": "CASE WHEN {n} >= 3 THEN avg(f) {w3} END"}), (there("kk"), {"d2": "CASE WHEN {n} >= 3 THEN avg(kk) {w3} END"}), (there("d2"), {"k2": "kk"})], k="k2", d="d2")
add("CCI(10)", "h l c", [(there("h l c"), {"w": "(h + l + c) / 3"}), (there("w"), {"v10": "list(w) {w10}"}), (there("w"), {"out": "CASE WHEN len(v10) >= 10 THEN CASE WHEN list_avg([abs(e - list_avg(v10)) for e in v10]) > 0 THEN (w - list_avg(v10)) / (0.015e0 * list_avg([abs(e - list_avg(v10)) for e in v10])) ELSE 0 END END"})])
_U = "CASE WHEN sum(tr) {{w{k}}} > 0 THEN sum(bp) {{w{k}}} / sum(tr) {{w{k}}} ELSE 0 END"
add("UltimateOscillator(3, 5, 8)", "h l c", [(there("h l c"), {"bp": "coalesce(c - least(l, lag(c) {s}), 0) * (lag(c) {s} IS NOT NULL)::INT", "tr": "CASE WHEN lag(c) {s} IS NULL THEN 0 ELSE greatest(h, lag(c) {s}) - least(l, lag(c) {s}) END"}), (there("h l c"), {"out": "CASE WHEN {n} >= 9 THEN 100 * (4 * " + _U.format(k=3) + " + 2 * " + _U.format(k=5) + " + " + _U.format(k=8) + ") / 7 END"})])
add("MFI(10)", "h l c v", [(there("h l c"), {"w": "(h + l + c) / 3"}), (there("w"), {"d": "coalesce(w - lag(w) {s}, 0)"}), (there("w"), {"out": "CASE WHEN {n} >= 11 THEN CASE WHEN sum(CASE WHEN d <> 0 THEN w * v ELSE 0 END) {w10} > 0 THEN 100 * sum(CASE WHEN d > 0 THEN w * v ELSE 0 END) {w10} / sum(CASE WHEN d <> 0 THEN w * v ELSE 0 END) {w10} ELSE 100 END END"})])
add("OBV()", "c v", [(there("c v"), {"d": "CASE WHEN lag(c) {s} IS NULL OR c > lag(c) {s} THEN v WHEN c < lag(c) {s} THEN -v ELSE 0 END"}), (there("d"), {"out": "sum(d) {u}"})])
_TERMS = {"Parkinson": ("h l", "pow(ln(h / l), 2) / (4 * ln(2))"), "GarmanKlass": ("o h l c", "0.5e0 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(c / o), 2)"), "RogersSatchell": ("o h l c", "ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)")}


def ew(column: str, alpha: float, power: float = 1.0) -> str:
    """The decayed sum of a list, newest last."""
    return f"list_sum([{column}[len({column}) - i] * pow({1 - alpha!r}e0, {power} * i) for i in range(0, len({column}))])"


def _ones(column: str, alpha: float, power: float = 1.0) -> str:
    return f"list_sum([pow({1 - alpha!r}e0, {power} * i) for i in range(0, len({column}))])"


for _n, (_c, _t) in _TERMS.items():
    _ok = there(_c)
    add(f"Rolling{_n}Var(10)", _c, f"{G}avg({_t}) {{w10}} END", digits=9)
    add(f"Rolling{_n}Vol(10)", _c, f"{G}sqrt(avg({_t}) {{w10}}) END")
    _ew = [(_ok, {"v1": f"list({_t}) {{u}}"})]
    add(f"Ew{_n}Var(alpha=0.25)", _c, [*_ew, (_ok, {"out": f"{ew('v1', 0.25)} / {_ones('v1', 0.25)}"})], digits=9)
    add(f"Ew{_n}Vol(alpha=0.25)", _c, [*_ew, (_ok, {"out": f"sqrt({ew('v1', 0.25)} / {_ones('v1', 0.25)})"})])
_YZ = [(there("o h l c"), {"d": "ln(o / lag(c) {s})", "oc": "ln(c / o)", "rs": _TERMS["RogersSatchell"][1]}), (there("oc"), {"vo": G + "var_samp(oc) {w10} END", "mr": G + "avg(rs) {w10} END"}), (there("d"), {"vn": G + "var_samp(d) {w10} END"})]
_YZK = 0.34 / (1.34 + 11 / 9)
add("RollingYangZhangVar(10)", "o h l c", [*_YZ, (there("vn"), {"out": f"vn + {_YZK!r}e0 * vo + {1 - _YZK!r}e0 * mr"})], digits=9)
add("RollingYangZhangVol(10)", "o h l c", [*_YZ, (there("vn"), {"out": f"sqrt(vn + {_YZK!r}e0 * vo + {1 - _YZK!r}e0 * mr)"})])

# -- exponentially weighted -----------------------------------------------------------------------------------------------------

_A = 0.25
_M = lambda e: [(there("x"), {"v1": "list(x) {u}", "v2": "list(x * x) {u}", "v3": "list(pow(x, 3)) {u}", "v4": "list(pow(x, 4)) {u}"}), (there("x"), {"w": _ones("v1", _A), "w2": _ones("v1", _A, 2.0), "m1": ew("v1", _A), "m2": ew("v2", _A), "m3": ew("v3", _A), "m4": ew("v4", _A)}), (there("x"), {"n": "w * w / w2", "e1": "m1 / w", "e2": "m2 / w", "e3": "m3 / w", "e4": "m4 / w"}), (there("x"), {"out": e})]
_VAR = "(e2 - e1 * e1) * n / (n - 1)"
for _call, _e in (
    ("EwMean(alpha=0.25)", "e1"), ("EwVar(alpha=0.25)", f"CASE WHEN n > 1 THEN {_VAR} END"), ("EwStd(alpha=0.25)", f"CASE WHEN n > 1 THEN sqrt({_VAR}) END"), ("EwZscore(alpha=0.25)", f"CASE WHEN n > 1 THEN (x - e1) / sqrt({_VAR}) END"), ("EwRms(alpha=0.25)", "sqrt(e2)"),
    ("EwSkew(alpha=0.25)", "CASE WHEN n > 2 THEN (e3 - 3 * e1 * e2 + 2 * pow(e1, 3)) / pow(e2 - e1 * e1, 1.5e0) * sqrt(n * (n - 1)) / (n - 2) END"),
    ("EwKurt(alpha=0.25)", "CASE WHEN n > 3 THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * pow(e1, 4)) / pow(e2 - e1 * e1, 2) - 3 * (n - 1)) END"),
):
    add(_call, "x", _M(_e), digits=5)
_P = lambda e: [(there("x y"), {"v1": "list(x) {u}", "v2": "list(y) {u}", "v3": "list(x * y) {u}", "v4": "list(y * y) {u}", "v5": "list(x * x) {u}"}), (there("x y"), {"w": _ones("v1", _A), "w2": _ones("v1", _A, 2.0), "m1": ew("v1", _A), "m2": ew("v2", _A), "m3": ew("v3", _A), "m4": ew("v4", _A), "m5": ew("v5", _A)}), (there("x y"), {"n": "w * w / w2", "e1": "m1 / w", "e2": "m2 / w", "cv": "m3 / w - m1 * m2 / w / w", "vy": "m4 / w - pow(m2 / w, 2)", "vx": "m5 / w - pow(m1 / w, 2)"}), (there("x y"), {"out": f"CASE WHEN n > 1 THEN {e} END"})]
for _call, _e in (("EwCov(alpha=0.25)", "cv * n / (n - 1)"), ("EwCorr(alpha=0.25)", "cv / sqrt(vx * vy)"), ("EwBeta(alpha=0.25)", "cv / vy"), ("EwAlpha(alpha=0.25)", "e1 - cv / vy * e2"), ("EwSpread(alpha=0.25)", "x - cv / vy * y")):
    add(_call, "x y", _P(_e), digits=5)
add("EwKyleLambda(alpha=0.25)", "y x", _P("cv / vy"), digits=5)
add("EwResidualStd(alpha=0.25)", "x y", digits=4)
for _call, _c in (("BayesianRegression(alpha=0.05)", "x y"), ("EwYangZhangVar(alpha=0.25)", "o h l c"), ("EwYangZhangVol(alpha=0.25)", "o h l c")):
    add(_call, _c)
_E1 = [(there("x"), {"v1": "list(x) {u}"}), (there("x"), {"e1": f"{ew('v1', _A)} / {_ones('v1', _A)}"}), (there("x"), {"v2": "list(e1) {u}"}), (there("x"), {"e2": f"{ew('v2', _A)} / {_ones('v2', _A)}"}), (there("x"), {"v3": "list(e2) {u}"}), (there("x"), {"e3": f"{ew('v3', _A)} / {_ones('v3', _A)}"})]
add("DEMA(alpha=0.25)", "x", [*_E1, (there("x"), {"out": "2 * e1 - e2"})])
add("TEMA(alpha=0.25)", "x", [*_E1, (there("x"), {"out": "3 * e1 - 3 * e2 + e3"})])
add("TRIX(7)", "x", [*_E1, (there("x"), {"out": "100 * (e3 - lag(e3) {s}) / lag(e3) {s}"})])
_F, _S = 2 / 4, 2 / 8
add("MACD(3, 7, 4)", "x", [(there("x"), {"v1": "list(x) {u}"}), (there("x"), {"macd": f"{ew('v1', _F)} / {_ones('v1', _F)} - {ew('v1', _S)} / {_ones('v1', _S)}"}), (there("x"), {"v2": "list(macd) {u}"}), (there("x"), {"signal": f"{ew('v2', 0.4)} / {_ones('v2', 0.4)}"}), (there("x"), {"hist": "macd - signal"})])
add("ADOSC(3, 7)", "h l c v", [(there("c"), {"d": "sum(CASE WHEN h > l THEN ((c - l) - (h - c)) / (h - l) * v ELSE 0 END) {u}"}), (there("d"), {"v1": "list(d) {u}"}), (there("d"), {"out": f"{ew('v1', _F)} / {_ones('v1', _F)} - {ew('v1', _S)} / {_ones('v1', _S)}"})])


def wilder(column: str, w: int) -> str:
    """Wilder's mean of a list in closed form."""
    return f"CASE WHEN len({column}) >= {w} THEN list_avg({column}[1:{w}]) * pow({w - 1}e0 / {w}, len({column}) - {w}) + coalesce(list_sum([{column}[i] / {w} * pow({w - 1}e0 / {w}, len({column}) - i) for i in range({w + 1}, len({column}) + 1)]), 0) END"


_RSI = [(there("x"), {"d": "x - lag(x) {s}"}), (there("d"), {"v1": "list(greatest(d, 0)) {u}", "v2": "list(greatest(-d, 0)) {u}"}), (there("d"), {"g1": wilder("v1", 10), "g2": wilder("v2", 10)}), (there("g1"), {"rsi": "CASE WHEN g1 + g2 = 0 THEN 50 ELSE 100 * g1 / (g1 + g2) END"})]
add("RollingRSI(10)", "x", [*_RSI, (there("rsi"), {"out": "rsi"})])
add("StochRSI(10, 8, 2, 3)", "x", [*_RSI, (there("rsi"), {"f": "CASE WHEN {n} >= 8 THEN CASE WHEN max(rsi) {w8} > min(rsi) {w8} THEN 100 * (rsi - min(rsi) {w8}) / (max(rsi) {w8} - min(rsi) {w8}) ELSE 0 END END"}), (there("f"), {"kk": "CASE WHEN {n} >= 2 THEN avg(f) {w2} END"}), (there("kk"), {"d2": "CASE WHEN {n} >= 3 THEN avg(kk) {w3} END"}), (there("d2"), {"k2": "kk"})], k="k2", d="d2")
_TR = [(there("h l c"), {"d": "greatest(h - l, abs(h - lag(c) {s}), abs(l - lag(c) {s})) + 0 * lag(c) {s}"}), (there("d"), {"v1": "list(d) {u}"}), (there("d"), {"t": wilder("v1", 10)})]
add("ATR(10)", "h l c", [*_TR, (there("t"), {"out": "t"})])
add("NATR(10)", "h l c", [*_TR, (there("t"), {"out": "100 * t / c"})])
add("KeltnerChannels(10)", "h l c", [*_TR, (there("h l c"), {"v2": "list(c) {u}"}), (there("t"), {"mid": f"{ew('v2', 2 / 11)} / {_ones('v2', 2 / 11)}"}), (there("t"), {"lower": "mid - 2 * t", "upper": "mid + 2 * t"})])
for _call, _c in (("PlusDM(10)", "h l"), ("MinusDM(10)", "h l"), ("PlusDI(10)", "h l c"), ("MinusDI(10)", "h l c"), ("DX(10)", "h l c"), ("ADX(10)", "h l c"), ("ADXR(10)", "h l c"), ("KAMA(10)", "x")):
    add(_call, _c)

# -- filters, cycles ------------------------------------------------------------------------------------------------------------------

for _call in ("Butter(2, 0.2)", "ButterHighpass(2, 0.2)", "ButterBandpass(2, 0.1, 0.3)", "ButterBandstop(2, 0.1, 0.3)", "SuperSmoother(period=10.0)", "Decycler(period=20.0)", "RoofingFilter(hp_period=30.0, lp_period=8.0)", "KalmanFilter(0.01, 1.0)", "RollingHurst(32)", "Hampel(10)", "ImpulseClip(10)", "RollingSigmaClip(10, -2.0, 2.0)"):
    add(_call, "x")
for _call in ("DominantCycle()", "HilbertPhasor()", "CyclePhase()", "CycleFrequency()", "CycleAmplitude()", "CycleSine()", "TrendMode()", "MAMA()", "InstantaneousTrendline()"):
    add(_call, "x")

# -- microstructure, backtests ----------------------------------------------------------------------------------------------------------

add("HawkesIntensity(0.8, 0.5, 1.0)", "x", [(there("x"), {"v1": "list(x) {u}"}), (there("x"), {"out": "1 + coalesce(list_sum([0.5e0 * v1[i] * pow(0.8e0, len(v1) - i) for i in range(1, len(v1))]), 0)"})])
add("TickRuleSign()", "x", [(there("x"), {"d": "sign(x - lag(x) {s})"}), (there("x"), {"out": "last_value(CASE WHEN d <> 0 THEN d END IGNORE NULLS) {u}"})])
add("LeeReadySign()", "a b", [(there("a b"), {"d": "sign(a - lag(a) {s})"}), (there("a b"), {"t": "last_value(CASE WHEN d <> 0 THEN d END IGNORE NULLS) {u}"}), (there("a b"), {"out": "CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE t END"})])
add("AmihudIlliquidity(10)", "r v", [(there("r v"), {"d": "abs(r) / v"}), (there("d"), {"out": G + "avg(d) {w10} END"})], digits=9)
add("BulkVolumeClassifier(10)", "r")
add("RollSpread(10)", "p", [("true", {"d": "p - lag(p) {s}"}), (there("d"), {"e": "lag(d) {s}"}), (there("d e"), {"f": G + "covar_samp(d, e) {w10} END"}), (there("f"), {"out": "CASE WHEN f < 0 THEN 2 * sqrt(-f) END"})])
add("ContOFI()", "l h v p", "CASE WHEN lag(l) {s} IS NOT NULL THEN (CASE WHEN l >= lag(l) {s} THEN v ELSE 0 END) - (CASE WHEN l <= lag(l) {s} THEN lag(v) {s} ELSE 0 END) - (CASE WHEN h <= lag(h) {s} THEN p ELSE 0 END) + (CASE WHEN h >= lag(h) {s} THEN lag(p) {s} ELSE 0 END) END")
add("VPIN(150.0, 5)", "x y")
_PT = [
    (there("u p"), {"tg": "least(greatest(u, -0.6e0), 0.8e0)"}),
    (there("u p"), {"dp": "tg - coalesce(lag(tg) {s}, 0)", "held": "coalesce(lag(tg) {s}, 0)", "dm": "coalesce(p - lag(p) {s}, 0)"}),
    (there("u p"), {"fp": "p * (1 + sign(dp) * 0.01e0)"}),
    (there("u p"), {"cost": "dp * (fp - p) + abs(dp) * fp * 0.001e0"}),
    (there("u p"), {"pnl": "held * dm - cost", "position": "tg"}),
    (there("u p"), {"equity": "sum(pnl) {u}"}),
]
add("BacktestPriceTarget(0.02, 0.001, -0.6, 0.8)", "u p", _PT)
for _call, _c in (("BacktestOHLCOrders(0.001, 0.002)", "l a h b o h l c"), ("BacktestOHLCTarget(0.001, 0.1)", "u o h l c"), ("BacktestTradesOrders(0.001, 0.002)", "q a p b x v"), ("BacktestTradesTarget(0.001)", "u p v"), ("BacktestL1Orders(0.001, 0.002)", "p a o b mb ma v v"), ("BacktestL1Target(0.001, 0.1)", "u l h v v"), ("BacktestL1TradesOrders(0.001, 0.002)", "p a o b mb ma v v c v")):
    add(_call, _c)
add(
    "BacktestReport()", "x y u v",
    [(there("x y u v"), {"drawdown": "x - max(x) {u}", "cum_cost": "sum(v) {u}", "tv": "abs(u - coalesce(lag(u) {s}, 0))", "sharpe": "avg(y) {u} / nullif(stddev_samp(y) {u}, 0)"}), (there("x y u v"), {"turnover": "sum(tv) {u}", "trades": "sum((tv > 0)::INT) {u}", "max_drawdown": "least(min(drawdown) {u}, 0)"})],
)


# -- directional movement and further recursions -------------------------------------------------------------------------


def _directional(ok: str, close: str) -> list:
    f = "pow(9e0 / 10, {e})"
    def total(c: str) -> str:
        """Wilder's sum of a list in closed form: nine values seed it."""
        return f"CASE WHEN len({c}) >= 10 THEN list_sum([{c}[i] * {f.format(e=f'len({c}) - greatest(i, 9)')} for i in range(1, len({c}) + 1)]) END"

    return [
        (ok, {"up": "h - lag(h) {s}", "dn": "lag(l) {s} - l", "tr": f"greatest(h - l, abs(h - lag({close}) {{s}}), abs(l - lag({close}) {{s}})) + 0 * lag({close}) {{s}}"}),
        (there("tr"), {"v1": "list(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) {u}", "v2": "list(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) {u}", "v3": "list(tr) {u}"}),
        (there("tr"), {"pdm": total("v1"), "mdm": total("v2"), "st": total("v3")}),
        (there("st"), {"pdi": "100 * pdm / st", "mdi": "100 * mdm / st"}),
        (there("pdi"), {"dx": "CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END"}),
        (there("dx"), {"v4": "list(dx) {u}"}),
        (there("dx"), {"adx": wilder("v4", 10)}),
        (there("adx"), {"adxr": "(adx + lag(adx, 9) {s}) / 2"}),
    ]


def _oracle(key: str, stages: list, digits: int = 6, **outputs: str) -> None:
    ORACLES[key] = _sql(stages, outputs, digits)


_D2, _D3 = _directional(there("h l"), "l"), _directional(there("h l c"), "c")
_oracle("plus_dm", _D2, out="pdm")
_oracle("minus_dm", _D2, out="mdm")
_oracle("plus_di", _D3, out="pdi")
_oracle("minus_di", _D3, out="mdi")
_oracle("dx", _D3, out="dx")
_oracle("adx", _D3, plus_di="pdi", minus_di="mdi", adx="adx")
_oracle("adxr", _D3, out="adxr")
_oracle("ew_residual_std", [*_P("x - cv / vy * y"), (there("out"), {"v6": "list(out) {u}", "v7": "list(out * out) {u}"}), (there("out"), {"q1": ew("v6", _A), "q2": ew("v7", _A), "wq": _ones("v6", _A), "wr": _ones("v6", _A, 2.0)}), (there("out"), {"res": "CASE WHEN wq * wq / wr > 1 THEN sqrt(greatest((q2 / wq - pow(q1 / wq, 2)) * (wq * wq / wr) / (wq * wq / wr - 1), 0)) END"})], 4, out="res")
_EYZ = [
    (there("o h l c"), {"d": "ln(o / lag(c) {s})", "v1": "list(ln(c / o)) {u}", "v2": "list(pow(ln(c / o), 2)) {u}", "v3": f"list({_TERMS['RogersSatchell'][1]}) {{u}}"}),
    (there("d"), {"v4": "list(d) {u}", "v5": "list(d * d) {u}"}),
    (there("d"), {"w1": _ones("v1", _A), "w2": _ones("v1", _A, 2.0), "w4": _ones("v4", _A), "w5": _ones("v4", _A, 2.0)}),
    (there("d"), {"n1": "w1 * w1 / w2", "n4": "w4 * w4 / w5"}),
    (there("d"), {"day": f"({ew('v2', _A)} / w1 - pow({ew('v1', _A)} / w1, 2)) * n1 / (n1 - 1)", "rs": f"{ew('v3', _A)} / w1", "night": f"CASE WHEN n4 > 1 THEN ({ew('v5', _A)} / w4 - pow({ew('v4', _A)} / w4, 2)) * n4 / (n4 - 1) END", "kk": "CASE WHEN n4 > 1 THEN 0.34e0 / (1.34e0 + (n4 + 1) / (n4 - 1)) END"}),
    (there("night"), {"res": "night + kk * day + (1 - kk) * rs"}),
    (there("res"), {"rt": "sqrt(greatest(res, 0))"}),
]
_oracle("ew_yang_zhang_var", _EYZ, out="res")
_oracle("ew_yang_zhang_vol", _EYZ, out="rt")


def _impulse(call: str, n: int = 400) -> list[float]:
    """The response of a recursive filter to a single one: with it the filter is a weighted sum of the past."""
    from .operators import kernels as k

    chain = {"Butter": [k.Butter(2, 0.2)], "ButterHighpass": [k.ButterHighpass(2, 0.2)], "ButterBandpass": [k.ButterBandpass(2, 0.1, 0.3)], "ButterBandstop": [k.ButterBandstop(2, 0.1, 0.3)], "SuperSmoother": [k.SuperSmoother(10.0, None)], "Decycler": [k.Decycler(20.0, None)], "RoofingFilter": [k.Highpass2(30.0), k.SuperSmoother(8.0, None)]}[call]
    out = [1.0] + [0.0] * (n - 1)
    for f in chain:
        out = [f.step(x) for x in out]
    return out


for _n in ("Butter", "ButterHighpass", "ButterBandpass", "ButterBandstop", "SuperSmoother", "Decycler", "RoofingFilter"):
    _w = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _impulse(_n, 160)) + "]"
    _oracle(snake(_n), [(there("x"), {"v1": "list(x) {u}"}), (there("x"), {"out": f"list_sum([v1[len(v1) - i] * ({_w})[i + 1] for i in range(0, least(len(v1), 160))])"})], out="out")

# -- series and recursions in SQL ------------------------------------------------------------------------------------------------


def _erf(z: str, terms: int) -> str:
    """The power series of the error function."""
    return f"(2 / sqrt(pi()) * list_sum([pow(-1, k) * pow({z}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)) for k in range(0, {terms})]))"


_oracle("erf", [(there("u"), {"out": _erf("u", 30)})], out="out")
_oracle("erfc", [(there("u"), {"out": "1 - " + _erf("u", 30)})], out="out")
_oracle("bulk_volume_classifier", [(there("r"), {"s": G + "stddev_samp(r) {w10} END"}), (there("s"), {"zz": "CASE WHEN s > 0 THEN r / s / sqrt(2) END"}), (there("zz"), {"out": f"0.5e0 * (1 + {_erf('zz', 60)})"})], out="out")


def _recursive(key: str, columns: str, state: dict[str, tuple[str, str]], digits: int = 6, before: list | None = None, **outputs: str) -> None:
    """SQL that walks each series row by row. `state` has for each variable its value at the first row and its value from
    the row before (r) and the row itself (t); `before` are stages that run first."""
    stages = [*(before or []), (there(columns), {"i_": "{n}"})]
    inner = _sql(stages, {"i_": "i_"})
    with_ = inner[: inner.rindex(" SELECT event_id")]
    last = f"s{len(stages)}"
    first = ", ".join(f"({a})::DOUBLE AS {n}" for n, (a, _) in state.items())
    later = ", ".join(f"({b})::DOUBLE AS {n}" for n, (_, b) in state.items())
    shown = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE round({c} + {_shift(digits)!r}::DOUBLE, {digits}) + 0e0 END AS {n}" for n, c in outputs.items())
    ORACLES[key] = (
        with_.replace("WITH ", "WITH RECURSIVE ", 1) + f", v_ AS (SELECT * FROM {last} WHERE ok_), w_ AS (SELECT t.event_id, t.user_id, t.i_, {first} FROM v_ t WHERE i_ = 1 UNION ALL SELECT t.event_id, t.user_id, t.i_, {later} FROM w_ r JOIN v_ t ON t.user_id = r.user_id AND t.i_ = r.i_ + 1)"
        f" SELECT b.event_id AS event_id, {shown} FROM s0 b LEFT JOIN w_ ON b.event_id = w_.event_id"
    ).replace("WHERE ok_", "WHERE i_ IS NOT NULL")


_recursive("kalman_filter", "x", {"pv": ("1 + 0.01e0", "(1 - r.g_) * r.pv + 0.01e0"), "g_": ("1.01e0 / 2.01e0", "((1 - r.g_) * r.pv + 0.01e0) / ((1 - r.g_) * r.pv + 1.01e0)"), "m_": ("t.x * 1.01e0 / 2.01e0", "r.m_ + (t.x - r.m_) * ((1 - r.g_) * r.pv + 0.01e0) / ((1 - r.g_) * r.pv + 1.01e0)")}, out="m_")
_recursive(
    "kama", "x", {"value": ("NULL", "CASE WHEN t.i_ > 10 THEN coalesce(r.value, r.px) + pow(t.er * (2e0 / 3 - 2e0 / 31) + 2e0 / 31, 2) * (t.x - coalesce(r.value, r.px)) END"), "px": ("t.x", "t.x")},
    before=[(there("x"), {"d": "abs(x - lag(x) {s})", "far": "abs(x - lag(x, 10) {s})"}), (there("x"), {"er": "CASE WHEN sum(d) {w10} > 0 THEN far / sum(d) {w10} ELSE 0 END"})], out="value",
)
_KEEP = "0.95e0"
_FADED = {v: f"({_KEEP} * r.{v} + 0.05e0 * {p})" for v, p in (("l11", 1), ("l12", 0), ("l22", 1), ("e1", 0), ("e2", 0), ("sq", 2), ("sh", 2))}
_START = {"l11": "1", "l12": "0", "l22": "1", "e1": "0", "e2": "0", "sq": "2", "sh": "2"}
_LEARN = {"l11": "1", "l12": "t.y", "l22": "t.y * t.y", "e1": "t.x", "e2": "t.x * t.y", "sq": "t.x * t.x", "sh": "0.5e0"}


def _forecast(p: dict[str, str]) -> tuple[str, str]:
    """Mean and deviation of the prediction under a prior."""
    det = f"({p['l11']} * {p['l22']} - {p['l12']} * {p['l12']})"
    mean = f"({p['l22']} * {p['e1']} - {p['l12']} * {p['e2']}) / {det} + ({p['l11']} * {p['e2']} - {p['l12']} * {p['e1']}) / {det} * t.y"
    fit = f"({p['l22']} * {p['e1']} * {p['e1']} - 2 * {p['l12']} * {p['e1']} * {p['e2']} + {p['l11']} * {p['e2']} * {p['e2']}) / {det}"
    lever = f"({p['l22']} - 2 * {p['l12']} * t.y + {p['l11']} * t.y * t.y) / {det}"
    return mean, f"sqrt(0.5e0 * ({p['sq']} - {fit}) / ({p['sh']} - 1) * (1 + {lever}))"


_F0, _F1 = _forecast(_START), _forecast(_FADED)
_DET = "(l11 * l22 - l12 * l12)"
_recursive(
    "bayesian_regression", "x y", {**{v: (f"{_START[v]} + {_LEARN[v]}", f"{_FADED[v]} + {_LEARN[v]}") for v in _START}, "pm": (_F0[0], _F1[0]), "ps": (_F0[1], _F1[1])},
    slope=f"(l11 * e2 - l12 * e1) / {_DET}", intercept=f"(l22 * e1 - l12 * e2) / {_DET}", pred_mean="pm", pred_std="ps",
)


def _walk(key: str, columns: str, mark: str, move: str, price: str, rate: str, before: list | None = None, fixed: str = "0") -> None:
    """A backtest whose fill at a row is one move at one price."""
    pos = "r.position"
    first = lambda e: e.replace("{pos}", "0")
    later = lambda e: e.replace("{pos}", pos)
    cost = f"({move}) * (({price}) - ({mark})) + abs({move}) * (({price}) * {rate} + {fixed})"
    state = {
        "position": (first(move), f"{pos} + ({later(move)})"),
        "cost": (first(cost), later(cost)),
        "pnl": (f"-({first(cost)})", f"{pos} * (({mark}) - r.mk) - ({later(cost)})"),
        "equity": (f"-({first(cost)})", f"r.equity + {pos} * (({mark}) - r.mk) - ({later(cost)})"),
        "mk": (mark, mark),
    }
    _recursive(key, columns, state, before=before, equity="equity", pnl="pnl", position="position", cost="cost")


_walk("backtest_trades_target", "u p v", "t.p", "(t.u - {pos})", "t.p", "0.001e0")
# a target book order sweeps one side: 10 to 110 are shown, so no move of up to 2 exceeds it
_walk("backtest_l1_target", "u l h v", "(t.l + t.h) / 2", "(t.u - {pos})", "CASE WHEN t.u > {pos} THEN t.h ELSE t.l END", "0.001e0")
_walk("backtest_ohlc_target", "o h l c", "t.c", "CASE WHEN t.tg IS NULL THEN 0 ELSE t.tg - {pos} END", "t.o + CASE WHEN t.tg > {pos} THEN 0.1e0 ELSE -0.1e0 END", "0.001e0", before=[("true", {"tg": "lag(u) {t}"})])



def _orders(key: str, valid: str, mark: str, buy: str, bought: str, sell: str, sold: str, state: dict[str, tuple[str, str]] | None = None) -> None:
    """A backtest of orders: amounts bought and sold and their costs at a row, and further state they rest on. {r.}
    stands for the row before, whose state is 0 at the first row."""
    first = lambda e: re.sub(r"\{r\.(\w+)\}", "0", e)
    later = lambda e: re.sub(r"\{r\.(\w+)\}", r"r.\1", e)
    move, cost = f"(({buy}) - ({sell}))", f"(({bought}) + ({sold}))"
    walk = {
        "position": (first(move), f"r.position + {later(move)}"),
        "cost": (first(cost), later(cost)),
        "pnl": (f"-{first(cost)}", f"r.position * (({mark}) - r.mk) - {later(cost)}"),
        "equity": (f"-{first(cost)}", f"r.equity + r.position * (({mark}) - r.mk) - {later(cost)}"),
        "mk": (mark, mark),
        **{k: (first(a), later(b)) for k, (a, b) in (state or {}).items()},
    }
    _recursive(key, valid, walk, equity="equity", pnl="pnl", position="position", cost="cost")


def _fill(size: str, sign: int, price: str, mark: str, rate: str) -> str:
    return f"{size} * ({sign} * ({price} - {mark}) + {price} * {rate})"


_SA, _SB = "coalesce(t.a, 0)", "coalesce(t.b, 0)"
_orders("backtest_ohlc_orders", "o h l c", "t.c", _SA, _fill(_SA, 1, "t.l", "t.c", "0.001e0"), _SB, _fill(_SB, -1, "t.h", "t.c", "0.001e0"))
_TB = "CASE WHEN t.x < t.q THEN coalesce(t.a, 0) WHEN t.x = t.q THEN least(coalesce(t.a, 0), t.v) ELSE 0 END"
_TS = "CASE WHEN t.x > t.p THEN coalesce(t.b, 0) WHEN t.x = t.p THEN least(coalesce(t.b, 0), t.v) ELSE 0 END"
_orders("backtest_trades_orders", "x v", "t.x", _TB, _fill(f"({_TB})", 1, "t.q", "t.x", "0.001e0"), _TS, _fill(f"({_TS})", -1, "t.p", "t.x", "0.001e0"))
_MID, _BUY, _SELL = "(t.mb + t.ma) / 2", "(coalesce(t.a, 0) > 0 AND t.p > t.ma)", "(coalesce(t.b, 0) > 0 AND t.o < t.mb)"
_RB, _RS = "(coalesce(t.a, 0) > 0 AND t.p <= t.ma)::INT", "(coalesce(t.b, 0) > 0 AND t.o >= t.mb)::INT"
_orders(
    "backtest_l1_orders", "mb ma", _MID,
    f"CASE WHEN {_BUY} THEN t.a ELSE 0 END", f"CASE WHEN NOT {_BUY} THEN 0 WHEN {{r.rb}} = 1 THEN {_fill('t.a', 1, 't.p', _MID, '0.001e0')} ELSE {_fill('t.a', 1, 't.ma', _MID, '0.002e0')} END",
    f"CASE WHEN {_SELL} THEN t.b ELSE 0 END", f"CASE WHEN NOT {_SELL} THEN 0 WHEN {{r.rs}} = 1 THEN {_fill('t.b', -1, 't.o', _MID, '0.001e0')} ELSE {_fill('t.b', -1, 't.mb', _MID, '0.002e0')} END",
    {"rb": (_RB, _RB), "rs": (_RS, _RS)},
)


def _tape_fill(size: str, sign: int, price: str, crossed: str, was: str) -> tuple[str, str]:
    """Amount and cost of one side where both the quotes and a print at c may fill it."""
    other = "t.ma" if sign > 0 else "t.mb"
    through = f"t.c {'<' if sign > 0 else '>'} {price}"
    amount = f"CASE WHEN coalesce({size}, 0) <= 0 THEN 0 WHEN {crossed} AND {was} = 0 THEN {size} WHEN t.c IS NULL THEN CASE WHEN {crossed} THEN {size} ELSE 0 END WHEN {through} THEN {size} WHEN t.c = {price} THEN least({size}, t.v) ELSE 0 END"
    cost = f"CASE WHEN coalesce({size}, 0) <= 0 THEN 0 WHEN {crossed} AND {was} = 0 THEN {_fill(size, sign, other, _MID, '0.002e0')} ELSE {_fill(f'({amount})', sign, price, _MID, '0.001e0')} END"
    return amount, cost


_B2, _S2 = _tape_fill("t.a", 1, "t.p", "t.p > t.ma", "{r.rb}"), _tape_fill("t.b", -1, "t.o", "t.o < t.mb", "{r.rs}")
_orders("backtest_l1_trades_orders", "mb ma", _MID, *_B2, *_S2, {"rb": (_RB, _RB), "rs": (_RS, _RS)})

# -- feedback filters and cycles, walked row by row ---------------------------------------------------------------------------


def _nested(key: str, start: dict[str, str], steps: list[dict[str, str]], digits: int = 6, **outputs: str) -> None:
    """SQL that walks the valid rows of x with a state of named columns, lists among them; each step of a row may use
    the columns of the steps before it and the state of the row before, whose names begin with p_."""
    keep = list(start)
    inner = "SELECT t.event_id, t.user_id, t.i_, t.x, " + ", ".join(f"r.{c} AS p_{c}" for c in keep) + " FROM w_ r JOIN v_ t ON t.user_id = r.user_id AND t.i_ = r.i_ + 1"
    for st in steps:
        inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in st.items())} FROM ({inner})"
    shown = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE round({c} + {_shift(digits)!r}::DOUBLE, {digits}) + 0e0 END AS {n}" for n, c in outputs.items())
    ORACLES[key] = (
        f"WITH RECURSIVE s0 AS ({_BASE}), v_ AS (SELECT event_id, user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i_ FROM s0 WHERE x IS NOT NULL), "
        f"w_ AS (SELECT NULL::BIGINT AS event_id, user_id, 0::BIGINT AS i_, {', '.join(f'{e} AS {n}' for n, e in start.items())} FROM (SELECT DISTINCT user_id FROM v_) UNION ALL SELECT event_id, user_id, i_, {', '.join(keep)} FROM ({inner})) "
        f"SELECT b.event_id AS event_id, {shown} FROM s0 b LEFT JOIN w_ ON b.event_id = w_.event_id"
    )


_LAST10 = "[-10:]"
_MEDIAN = lambda v: f"list_aggregate({v}, 'median')"
_SPREAD = lambda v, m: f"1.4826e0 * list_aggregate([abs(e - {m}) for e in {v}], 'median')"
_nested(
    "hampel", {"v": "[]::DOUBLE[]", "res": "NULL::DOUBLE"},
    [{"f": f"list_append(p_v, x){_LAST10}"}, {"m": _MEDIAN("f")}, {"sc": _SPREAD("f", "m")}, {"bad": "len(f) >= 10 AND sc > 0 AND abs(x - m) > 3 * sc"}, {"v": "CASE WHEN bad THEN list_append(f[:-2], m) ELSE f END", "res": "CASE WHEN len(f) >= 10 THEN CASE WHEN bad THEN m ELSE x END END"}],
    out="res",
)
_nested(
    "impulse_clip", {"v": "[]::DOUBLE[]", "j": "[]::DOUBLE[]", "px": "NULL::DOUBLE", "res": "NULL::DOUBLE"},
    [{"f": f"list_append(p_v, x){_LAST10}", "j": f"CASE WHEN p_px IS NULL THEN p_j ELSE list_append(p_j, x - p_px){_LAST10} END", "px": "x"}, {"m": _MEDIAN("f"), "jm": _MEDIAN("j")}, {"sc": _SPREAD("j", "jm")}, {"bad": "len(j) >= 10 AND sc > 0 AND abs(x - p_px) > 4 * sc"}, {"v": "CASE WHEN bad THEN list_append(f[:-2], m) ELSE f END", "res": "CASE WHEN len(j) >= 10 THEN CASE WHEN bad THEN m ELSE x END END"}],
    out="res",
)


def _clip_stages() -> list[dict[str, str]]:
    from .operators.kernels import truncated_normal

    shift, shrink = truncated_normal(-2.0, 2.0)
    return [
        {"zs": "CASE WHEN p_sd > 0 THEN (x - p_mu) / p_sd ELSE 0 END"},
        {"inn": "zs BETWEEN -2 AND 2"},
        {"v": f"CASE WHEN inn THEN list_append(p_v, x){_LAST10} ELSE p_v END"},
        {"sd": f"CASE WHEN inn AND len(v) = 10 THEN list_aggregate(v, 'stddev_samp') / {shrink!r}::DOUBLE ELSE p_sd END"},
        {"mu": f"CASE WHEN inn AND len(v) = 10 THEN list_avg(v) - {shift!r}::DOUBLE * sd ELSE p_mu END"},
        {"res": "CASE WHEN len(v) = 10 THEN CASE WHEN inn THEN x WHEN zs < -2 THEN mu - 2 * sd ELSE mu + 2 * sd END END"},
    ]


_nested("rolling_sigma_clip", {"v": "[]::DOUBLE[]", "mu": "NULL::DOUBLE", "sd": "NULL::DOUBLE", "res": "NULL::DOUBLE"}, _clip_stages(), out="res")
_Z7 = "[0, 0, 0, 0, 0, 0, 0]::DOUBLE[]"
_H = lambda v: f"(0.0962e0 * {v}[1] + 0.5769e0 * {v}[3] - 0.5769e0 * {v}[5] - 0.0962e0 * {v}[7]) * adj"
_CYCLE = (
    {**dict.fromkeys(("pr", "sm", "de", "ci", "cq"), _Z7), **dict.fromkeys(("i2", "q2", "re", "im", "per", "sper"), "0::DOUBLE"), **dict.fromkeys(("ph", "amp", "mama", "fama", "px", "ln", "pln", "tm"), "NULL::DOUBLE")},
    [
        {"adj": "0.075e0 * p_per + 0.54e0", "pr": "list_prepend(x, p_pr[1:6])"},
        {"sm": "list_prepend((4 * pr[1] + 3 * pr[2] + 2 * pr[3] + pr[4]) / 10, p_sm[1:6])"},
        {"de": f"list_prepend({_H('sm')}, p_de[1:6])"},
        {"cq": f"list_prepend({_H('de')}, p_cq[1:6])", "ci": "list_prepend(de[4], p_ci[1:6])"},
        {"i2": f"0.2e0 * (ci[1] - {_H('cq')}) + 0.8e0 * p_i2", "q2": f"0.2e0 * (cq[1] + {_H('ci')}) + 0.8e0 * p_q2"},
        {"re": "0.2e0 * (i2 * p_i2 + q2 * p_q2) + 0.8e0 * p_re", "im": "0.2e0 * (i2 * p_q2 - q2 * p_i2) + 0.8e0 * p_im"},
        {"a0": "CASE WHEN re <> 0 AND im <> 0 THEN 2 * pi() / atan(im / re) ELSE p_per END"},
        {"a1": "CASE WHEN p_per > 0 THEN least(greatest(a0, 0.67e0 * p_per), 1.5e0 * p_per) ELSE a0 END"},
        {"per": "0.2e0 * least(greatest(a1, 6), 50) + 0.8e0 * p_per"},
        {"sper": "0.33e0 * per + 0.67e0 * p_sper", "deg": "degrees(atan2(cq[1], ci[1]))", "warm": "i_ > 40"},
        {"ph": "CASE WHEN warm THEN CASE WHEN deg < 0 THEN deg + 360 ELSE deg END END", "amp": "sqrt(i2 * i2 + q2 * q2)"},
        {"al": "CASE WHEN p_ph IS NULL THEN 0.5e0 ELSE least(greatest(0.5e0 / greatest(p_ph - ph, 1), 0.05e0), 0.5e0) END", "a": "2 / (sper + 1)", "turn": "ph - p_ph"},
        {"mama": "CASE WHEN warm THEN coalesce(al * x + (1 - al) * p_mama, x) END", "px": "x", "pln": "p_ln", "tm": "CASE WHEN warm THEN CASE WHEN p_ph IS NULL THEN 0 ELSE (abs(CASE WHEN turn > 180 THEN turn - 360 WHEN turn < -180 THEN turn + 360 ELSE turn END) < 180 / sper)::INT END END"},
        {"fama": "CASE WHEN warm THEN coalesce(al / 2 * mama + (1 - al / 2) * p_fama, x) END", "ln": "CASE WHEN i_ > 42 THEN (a - a * a / 4) * x + a * a / 2 * pr[2] - (a - 0.75e0 * a * a) * pr[3] + 2 * (1 - a) * p_ln - (1 - a) * (1 - a) * p_pln WHEN warm THEN x END"},
    ],
)
_W = lambda e: f"(CASE WHEN w_.i_ > 40 THEN {e} END)"
_nested("dominant_cycle", *_CYCLE, out=_W("sper"))
_nested("hilbert_phasor", *_CYCLE, inphase=_W("i2"), quadrature=_W("q2"))
_nested("cycle_phase", *_CYCLE, out="ph")
_nested("cycle_frequency", *_CYCLE, out=_W("1 / sper"))
_nested("cycle_amplitude", *_CYCLE, out=_W("amp"))
_nested("cycle_sine", *_CYCLE, sine="sin(radians(ph))", lead="sin(radians(ph) + pi() / 4)")
_nested("trend_mode", *_CYCLE, out="tm")
_nested("mama", *_CYCLE, mama="mama", fama="fama")
_nested("instantaneous_trendline", *_CYCLE, out="ln")

ORACLES["vpin"] = f"""WITH s0 AS ({_BASE}), v AS (SELECT event_id, user_id, ts, x AS buy, x + y AS vol FROM s0 WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT *, sum(vol) OVER w AS tv, sum(vol) OVER w - vol AS pv, sum(buy) OVER w - buy AS pb FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT user_id, pb, buy, pv, vol, unnest(range(floor(pv / 150)::BIGINT + 1, floor(tv / 150)::BIGINT + 1)) AS k FROM c),
i AS (SELECT user_id, k, pb + buy * (k * 150 - pv) / vol AS bought FROM e),
d AS (SELECT user_id, k, abs(2 * (bought - lag(bought, 1, 0) OVER (PARTITION BY user_id ORDER BY k)) - 150) AS gap FROM i),
m AS (SELECT user_id, k, avg(gap) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 150 AS res FROM d)
SELECT b.event_id AS event_id, round(res + {_shift(6)!r}::DOUBLE, 6) + 0e0 AS out FROM s0 b LEFT JOIN c ON b.event_id = c.event_id LEFT JOIN m ON c.user_id = m.user_id AND m.k = floor(c.tv / 150) AND m.k >= 5"""


def _hurst_stages() -> list:
    from .operators.kernels import Hurst

    k = Hurst(32, 4, "rs")
    logs = [math.log(n) for n in k.scales]
    mid = sum(logs) / len(logs)
    spread = sum((v - mid) ** 2 for v in logs)
    means = [(there("x"), {"hv": "list(x) {w32}"})]
    for n in k.scales:
        block = f"hv[p * {n} + 1:p * {n} + {n}]"
        walk = f"[list_sum({block}[1:j]) - j * list_avg({block}) for j in range(1, {n} + 1)]"
        means.append((there("x"), {f"rs{n}": f"CASE WHEN len(hv) = 32 THEN list_avg([(greatest(list_max({walk}), 0) - least(list_min({walk}), 0)) / list_aggregate({block}, 'stddev_pop') for p in range(0, {32 // n})]) END"}))
    terms = " + ".join(f"{(v - mid) / spread!r}::DOUBLE * ln(rs{n} - {e!r}::DOUBLE + {math.sqrt(0.5 * math.pi * n)!r}::DOUBLE)" for n, v, e in zip(k.scales, logs, k.expected, strict=True))
    return [*means, (" AND ".join(f"rs{n} IS NOT NULL" for n in k.scales), {"out": terms})]


_oracle("rolling_hurst", _hurst_stages(), out="out")

# -- streams, bars, reports ---------------------------------------------------------------------------------------------------

_LEFT = "SELECT user_id, ts, event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS x FROM events WHERE event_type = 'click'"
_RIGHT = "SELECT user_id, ts, event_id, value * 2 AS y FROM events WHERE event_type = 'view'"


def _streams(spark: SparkSession, sf_dir: str):
    from .operators.streams import Stream

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = events.where("event_type = 'click'").selectExpr("user_id", "ts", "event_id", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS x")
    right = events.where("event_type = 'view'").selectExpr("user_id", "ts", "event_id", "value * 2 AS y")
    return Stream(left, "ts", "x", "user_id", "event_id"), Stream(right, "ts", "y", "user_id", "event_id")


def _ticks(spark: SparkSession, sf_dir: str):
    from .operators.streams import Stream

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "ts", "event_id", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS x", "CASE WHEN event_id % 4 = 0 THEN -1e0 ELSE 2e0 END AS v")
    return Stream(rows, "ts", ["x", "v"], "event_type", "event_id")


_TICKS = "SELECT event_type, ts, event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS x, CASE WHEN event_id % 4 = 0 THEN -1e0 ELSE 2e0 END AS v FROM events"


def _stream(name: str, run, names: str, sql: str | None, digits: int = 6, keys: str = "user_id ts") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators.streams import Stream

        out = run(spark, sf_dir)
        df = out.df if hasattr(out, "df") else out
        df = df.withColumn("ts", Stream(df, "ts", []).micros("ts"))
        return tidy(df.select(*keys.split(), *names.split()), names.split(), digits)

    QUERIES[name] = query
    if sql:
        cols = ", ".join([*("epoch_us(ts) AS ts" if k == "ts" else k for k in keys.split()), *(f"CASE WHEN isnan({n}::DOUBLE) THEN NULL ELSE round({n} + {_shift(digits)!r}::DOUBLE, {digits}) + 0e0 END AS {n}" for n in names.split())])
        ORACLES[name] = f"SELECT {cols} FROM ({sql})"


def _run(fn, *args, make_streams=_streams, **kw):
    def run(spark: SparkSession, sf_dir: str):
        from .operators import streams as st

        s = make_streams(spark, sf_dir)
        return getattr(st, fn)(*(s if isinstance(s, tuple) else (s,)), *args, **kw)

    return run


def _one(fn, *args, **kw):
    return lambda spark, sf_dir: _run(fn, *args, make_streams=lambda a, b: _streams(a, b)[0], **kw)(spark, sf_dir)


_ALIGNED = f"""SELECT user_id, ts, last_value(wx IGNORE NULLS) OVER p AS sx, last_value(wy IGNORE NULLS) OVER p AS sy FROM (
SELECT user_id, ts, any_value(wx) AS wx, any_value(wy) AS wy FROM (SELECT user_id, ts, {{{{'v': x}}}} AS wx, NULL AS wy FROM ({_LEFT}) UNION ALL SELECT user_id, ts, NULL, {{{{'v': y}}}} FROM ({_RIGHT})) GROUP BY user_id, ts)
WINDOW p AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("{{", "{").replace("}}", "}")
_stream("combine_latest", _run("combine_latest"), "x y", f"SELECT user_id, ts, sx.v AS x, sy.v AS y FROM ({_ALIGNED}) WHERE sx IS NOT NULL AND sy IS NOT NULL")
_stream("combine_latest_on_any", _run("combine_latest", emit="on_any"), "x y", f"SELECT user_id, ts, sx.v AS x, sy.v AS y FROM ({_ALIGNED})")
_stream("filter", lambda s, d: _run("filter_by", make_streams=lambda a, b: (_streams(a, b)[0], _streams(a, b)[1].like(_streams(a, b)[1].df.withColumn("y", (F.col("y") > 60).cast("double")))))(s, d), "x", f"SELECT user_id, ts, sx.v AS x FROM ({_ALIGNED}) WHERE sx IS NOT NULL AND sy.v > 60")
_stream("merge", lambda s, d: _run("merge")(s, d).withColumn("source", F.col("source").cast("double")), "source x", f"SELECT user_id, ts, 0e0 AS source, x FROM ({_LEFT}) UNION ALL SELECT user_id, ts, 1e0, y FROM ({_RIGHT})")


def _split_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import streams as st

    return st.split(st.merge(*_streams(spark, sf_dir)), 2)[1]


_stream("split", _split_back, "x", f"SELECT user_id, ts, y AS x FROM ({_RIGHT})")
_stream("select", lambda s, d: _run("select", [1], make_streams=_ticks)(s, d), "v", f"SELECT event_type, ts, v FROM ({_TICKS})", keys="event_type ts")
_stream("dropna", _one("dropna"), "x", f"SELECT user_id, ts, x FROM ({_LEFT}) WHERE x IS NOT NULL")
_stream("delay", _one("delay", "90s"), "x", f"SELECT user_id, ts + INTERVAL 90 SECOND AS ts, x FROM ({_LEFT})")
_BUCKET = "floor((epoch_us(ts) - 600000000) / 3600000000)"
_FIRSTS = "arg_min(x, (ts, event_id)) FILTER (x IS NOT NULL)"
_LASTS = "arg_max(x, (ts, event_id)) FILTER (x IS NOT NULL)"
_AGGS = {"first": _FIRSTS, "last": _LASTS, "min": "min(x)", "max": "max(x)", "mean": "avg(x)", "sum": "coalesce(sum(x), 0)", "count": "count(x)", "std": "stddev_samp(x)", "var": "var_samp(x)", "prod": "product(1 + x / 1000)", "skew": "CASE WHEN count(x) >= 3 THEN skewness(x) END", "kurt": "CASE WHEN count(x) >= 4 THEN kurtosis(x) END"}


def _only_x(spark: SparkSession, sf_dir: str):
    t = _ticks(spark, sf_dir)
    return t.like(t.df.drop("v"), ["x"])


def _factors(spark: SparkSession, sf_dir: str):
    t = _only_x(spark, sf_dir)
    return t.like(t.df.withColumn("x", 1 + F.col("x") / 1000))


for _n, _e in _AGGS.items():
    _stream(f"resample_{_n}", _run("resample", _n, freq="h", origin=600, make_streams=_factors if _n == "prod" else _only_x), "x", f"SELECT event_type, make_timestamp((k * 3600000000 + 600000000)::BIGINT) AS ts, x FROM (SELECT event_type, {_BUCKET} AS k, {_e} AS x FROM ({_TICKS}) GROUP BY 1, 2)", keys="event_type ts")
_stream("resample_right_label", _run("resample", "last", every="6h", label="right", make_streams=_only_x), "x", f"SELECT event_type, make_timestamp(((k + 1) * 21600000000)::BIGINT) AS ts, x FROM (SELECT event_type, floor(epoch_us(ts) / 21600000000) AS k, {_LASTS} AS x FROM ({_TICKS}) GROUP BY 1, 2)", keys="event_type ts")
_BAR = f"{_FIRSTS} AS open, max(x) AS high, min(x) AS low, {_LASTS} AS close"
_stream("resample_ohlc", _run("resample", "ohlc", freq="h", make_streams=_only_x), "open high low close", f"SELECT event_type, make_timestamp((k * 3600000000)::BIGINT) AS ts, open, high, low, close FROM (SELECT event_type, floor(epoch_us(ts) / 3600000000) AS k, {_BAR} FROM ({_TICKS}) GROUP BY 1, 2)", keys="event_type ts")
_stream("resample_ohlcv", _run("resample", "ohlcv", freq="h", make_streams=_ticks), "open high low close volume", f"SELECT event_type, make_timestamp((k * 3600000000)::BIGINT) AS ts, open, high, low, close, volume FROM (SELECT event_type, floor(epoch_us(ts) / 3600000000) AS k, {_BAR}, sum(v) AS volume FROM ({_TICKS}) GROUP BY 1, 2)", keys="event_type ts")
_stream("resample_ohlcv2", _run("resample", "ohlcv2", freq="h", make_streams=_ticks), "close buy_volume sell_volume", f"SELECT event_type, make_timestamp((k * 3600000000)::BIGINT) AS ts, close, b AS buy_volume, s AS sell_volume FROM (SELECT event_type, floor(epoch_us(ts) / 3600000000) AS k, {_BAR}, coalesce(sum(v) FILTER (v > 0), 0) AS b, coalesce(sum(-v) FILTER (v < 0), 0) AS s FROM ({_TICKS}) GROUP BY 1, 2)", keys="event_type ts")


def _bars_of_bars(agg: str):
    def run(spark: SparkSession, sf_dir: str):
        from .operators.streams import resample

        small = resample(_ticks(spark, sf_dir), "ohlcv", freq="h")
        small = small if agg == "ohlcv_bars" else small.like(small.df.drop("volume"), small.values[:4])
        return resample(small, agg, freq="D")

    return run


_DAY = f"SELECT event_type, k // 24 AS day, arg_min(open, k) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low, arg_max(close, k) FILTER (close IS NOT NULL) AS close, sum(volume) AS volume FROM (SELECT event_type, epoch_us(ts) // 3600000000 AS k, {_BAR}, sum(v) AS volume FROM ({_TICKS}) GROUP BY 1, 2) GROUP BY 1, 2"
_stream("resample_ohlc_bars", _bars_of_bars("ohlc_bars"), "open high low close", f"SELECT event_type, make_timestamp((day * 86400000000)::BIGINT) AS ts, open, high, low, close FROM ({_DAY})", keys="event_type ts")
_stream("resample_ohlcv_bars", _bars_of_bars("ohlcv_bars"), "open high low close volume", f"SELECT event_type, make_timestamp((day * 86400000000)::BIGINT) AS ts, open, high, low, close, volume FROM ({_DAY})", keys="event_type ts")
_GAPS = f"""WITH b AS (SELECT user_id, floor(epoch_us(ts) / 21600000000)::BIGINT AS k, {_LASTS} AS x FROM ({_LEFT}) GROUP BY 1, 2),
a AS (SELECT user_id, unnest(range(min(k), max(k) + 1)) AS k FROM b GROUP BY 1) SELECT a.user_id AS user_id, make_timestamp(a.k * 21600000000) AS ts, {{x}} AS x FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.k = b.k"""
_stream("resample_fill_nan", _one("resample", "last", freq="6h", fill="nan"), "x", _GAPS.format(x="b.x"))
_stream("resample_fill_carry", _one("resample", "last", freq="6h", fill="carry"), "x", "SELECT user_id, ts, last_value(w IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).v AS x FROM (" + _GAPS.replace("{x} AS x", "CASE WHEN b.k IS NOT NULL THEN struct_pack(v := b.x) END AS w") + ")")
_stream("resample_count", _run("resample", "mean", count=7, make_streams=_only_x), "x", f"SELECT event_type, min(ts) AS ts, avg(x) AS x FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 7 AS k FROM ({_TICKS})) GROUP BY event_type, k", keys="event_type ts")


def _with_operator(spark: SparkSession, sf_dir: str):
    from .operators.streams import resample

    out = resample(_only_x(spark, sf_dir), make("ExpandingSkew"), freq="D")
    return out.like(out.df.withColumnRenamed("value", "x"), ["x"])


_stream("resample_operator", _with_operator, "x", f"SELECT event_type, make_timestamp((k * 86400000000)::BIGINT) AS ts, x FROM (SELECT event_type, epoch_us(ts) // 86400000000 AS k, CASE WHEN count(x) >= 3 THEN skewness(x) END AS x FROM ({_TICKS}) GROUP BY 1, 2)", keys="event_type ts")
_stream("resample_threshold", lambda s, d: _run("resample", "ohlc", threshold=300.0, driver="x", make_streams=_only_x)(s, d), "open high low close", f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM ({_TICKS})),
r AS (SELECT event_type, ts, event_id, x, i, 0 AS bar, coalesce(x, 0) AS total FROM t WHERE i = 1 UNION ALL
SELECT t.event_type, t.ts, t.event_id, t.x, t.i, CASE WHEN r.total >= 300 THEN r.bar + 1 ELSE r.bar END, coalesce(t.x, 0) + CASE WHEN r.total >= 300 THEN 0 ELSE r.total END FROM r JOIN t ON t.event_type = r.event_type AND t.i = r.i + 1)
SELECT event_type, min(ts) AS ts, {_BAR} FROM r GROUP BY event_type, bar""", keys="event_type ts")
_CLOCK = f"SELECT c.user_id AS user_id, c.ts AS ts, {{e}} AS x FROM (SELECT DISTINCT user_id, ts FROM ({_RIGHT})) c {{j}}"
_ASOF = f"ASOF LEFT JOIN (SELECT user_id, ts AS seen, x AS vx FROM ({_LEFT}) WHERE x IS NOT NULL) v ON c.user_id = v.user_id AND c.ts >= v.seen"


def _clocked(agg: str, fill: str, **kw):
    def run(spark: SparkSession, sf_dir: str):
        from .operators.streams import resample

        left, right = _streams(spark, sf_dir)
        return resample(left, agg, clock=right, fill=fill, **kw)

    return run


_stream("resample_clock_carry", _clocked("last", "carry"), "x", _CLOCK.format(e="vx", j=_ASOF))
_stream("resample_clock_max_age", _clocked("last", "carry", max_age="6h"), "x", _CLOCK.format(e="CASE WHEN c.ts - v.seen <= INTERVAL 6 HOUR THEN vx END", j=_ASOF))
_TICKED = f"(SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM (SELECT DISTINCT user_id, ts FROM ({_RIGHT}))) c LEFT JOIN ({_LEFT}) v ON v.user_id = c.user_id AND v.ts <= c.ts AND (c.before IS NULL OR v.ts > c.before) GROUP BY c.user_id, c.ts"
_stream("resample_clock_sum", _clocked("sum", "skip"), "x", f"SELECT c.user_id AS user_id, c.ts AS ts, sum(x) AS x FROM {_TICKED} HAVING count(x) > 0")
_stream("resample_clock_nan", _clocked("max", "nan"), "x", f"SELECT c.user_id AS user_id, c.ts AS ts, max(x) AS x FROM {_TICKED}")


def _pairs(spark: SparkSession, sf_dir: str):
    from .operators.streams import forecast_pairs

    return forecast_pairs(*_streams(spark, sf_dir), duration="6h")


_stream("forecast_pairs", _pairs, "x y", f"SELECT user_id, ts, x, y FROM (SELECT c.user_id AS user_id, c.ts AS ts, v.w.v AS x, c.y AS y, v.w AS w FROM ({_RIGHT}) c ASOF LEFT JOIN (SELECT user_id, ts + INTERVAL 6 HOUR AS seen, struct_pack(v := x) AS w FROM ({_LEFT}) WHERE x IS NOT NULL) v ON c.user_id = v.user_id AND c.ts >= v.seen)")


def _side_by_side(spark: SparkSession, sf_dir: str):
    left = _streams(spark, sf_dir)[0]
    return left, left.like(left.df.withColumn("y", F.col("x") * 2 + 1).drop("x"), ["y"])


def _positions(spark: SparkSession, sf_dir: str):
    from .operators.streams import zip_streams

    return zip_streams(*_side_by_side(spark, sf_dir))


def _pairs_by_count(spark: SparkSession, sf_dir: str):
    from .operators.streams import forecast_pairs

    return forecast_pairs(*_side_by_side(spark, sf_dir), count=2)


_PLACED = f"SELECT user_id, make_timestamp(row_number() OVER w - 1) AS ts, {{x}} AS x, x * 2 + 1 AS y FROM ({_LEFT}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_stream("combine_latest_positional", _positions, "x y", _PLACED.format(x="x"))
_stream("forecast_pairs_count", _pairs_by_count, "x y", _PLACED.format(x="lag(x, 2) OVER w"))


def _graph(spark: SparkSession, sf_dir: str):
    """A pipeline that was written as JSON and read again: a rolling mean over hourly bars without empty ones."""
    from .plans.pipeline import Pipeline, apply, flow, source

    ticks = source("ticks")
    bars = flow("dropna", flow("resample", ticks, agg="mean", freq="h"))
    graph = Pipeline.from_json(Pipeline([ticks], {"smooth": apply(make("RollingMean", 3, "expanding"), bars)}).to_json())
    return graph(ticks=_only_x(spark, sf_dir))["smooth"]


_stream("pipeline_graph", _graph, "x", f"SELECT event_type, make_timestamp(k * 3600000000) AS ts, avg(m) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM (SELECT event_type, epoch_us(ts) // 3600000000 AS k, avg(x) AS m FROM ({_TICKS}) GROUP BY 1, 2 HAVING count(x) > 0)", keys="event_type ts")


def _portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.backtest import portfolio_report

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id % 10 AS asset", "event_type", "date_trunc('day', ts) AS ts", "value").groupBy("asset", "event_type", "ts").agg(F.sum("value").alias("equity"), F.avg("value").alias("pnl"), F.count("value").cast("double").alias("position"), F.max("value").alias("cost"))
    return portfolio_report(rows, "asset", ["ts"], key=["event_type"])


_stream("portfolio_report", _portfolio, "drawdown cum_cost turnover trades max_drawdown sharpe", """WITH a AS (SELECT user_id % 10 AS asset, event_type, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS equity, avg(value) AS pnl, count(value)::DOUBLE AS position, max(value) AS cost FROM events GROUP BY ALL),
m AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY event_type, asset ORDER BY ts), 0)) AS moved FROM a),
t AS (SELECT event_type, ts, sum(equity) AS equity, sum(pnl) AS pnl, sum(cost) AS cost, sum(moved) AS turn, sum((moved > 0)::INT) AS tr FROM m GROUP BY ALL),
d AS (SELECT *, equity - max(equity) OVER w AS dd FROM t WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_type, ts, dd AS drawdown, sum(cost) OVER w AS cum_cost, sum(turn) OVER w AS turnover, sum(tr) OVER w AS trades, least(min(dd) OVER w, 0) AS max_drawdown, avg(pnl) OVER w / nullif(stddev_samp(pnl) OVER w, 0) AS sharpe FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", keys="event_type ts")


# -- Structured Streaming ---------------------------------------------------------------------------------------------------------


def _live(outputs: dict[str, Node]) -> Query:
    """A query over the events as a stream: read as files arrive, state kept by key, written and read again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources.folders import scratch
        from .streaming.live import live_kernels

        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        out = scratch(spark, "live")
        rows = live_kernels(events.selectExpr(*[f"{COLUMNS[c]} AS {c}" for c in ("event_id", "user_id", "ts", "x")], "value"), "user_id", ["ts", "event_id"], outputs)
        rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
        return tidy(spark.read.parquet(out).select("event_id", *outputs), list(outputs))

    return query


live_ew_mean = _live({"out": make("EwMean", alpha=0.25)("value")})
# graphs of operators on a stream give what the batch queries of the same name give
for _live_name, _live_of in (("macd", make("MACD", 3, 7, 4)("x")), ("stoch_rsi", make("StochRSI", 10, 8, 2, 3)("x")), ("trix", make("TRIX", 7)("x")), ("rolling_mean_20", make("RollingMean", 20)("x"))):
    QUERIES[f"live_{_live_name}"] = _live({o or "out": _live_of[i] for i, o in enumerate(_live_of.spec.outputs)})
    ORACLES[f"live_{_live_name}"] = ORACLES[_live_name]
QUERIES["live_ew_mean"] = live_ew_mean
ORACLES["live_ew_mean"] = (
    f"SELECT event_id, round({ew('v1', _A)} / {_ones('v1', _A)} + {_shift(6)!r}::DOUBLE, 6) + 0e0 AS out "
    "FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v1 FROM events)"
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
