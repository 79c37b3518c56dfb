import json

import numpy as np
import pandas as pd
import pytest

import tidewater as tw
from tidewater.operators import streams as st
from tidewater.operators.streams import Stream
from tidewater.plans.pipeline import Pipeline, apply, flow, source
from tidewater.sources import frames


def stream(spark, ts, values, name="v"):
    return Stream(spark.createDataFrame([(int(t), i, None if v is None else float(v)) for i, (t, v) in enumerate(zip(ts, values, strict=True))], f"ts long, seq int, {name} double"), "ts", name, seq="seq")


def rows(s, *cols):
    return [tuple(r) for r in s.df.orderBy(s.ts, *s.seq).select(s.ts, *(cols or s.values)).collect()]


def test_combine_latest(spark):
    a, b = stream(spark, [1, 2, 4], [10, 20, 40], "a"), stream(spark, [1, 3, 4], [1, 3, 4], "b")
    assert rows(st.combine_latest(a, b)) == [(1, 10, 1), (2, 20, 1), (3, 20, 3), (4, 40, 4)]
    c = stream(spark, [2, 2, 5], [7, 8, None], "c")
    assert rows(st.combine_latest(a, c, emit="on_any")) == [(1, 10, None), (2, 20, 8), (4, 40, 8), (5, 40, None)]
    assert rows(st.combine_latest(a, c)) == [(2, 20, 8), (4, 40, 8), (5, 40, None)]
    assert st.combine_latest(a, a).values == ["a_0", "a_1"]


def test_filter_dropna_select_delay(spark):
    a, m = stream(spark, [1, 2, 3, 4], [1, None, 3, 4], "a"), stream(spark, [1, 3], [1, 0], "m")
    assert rows(st.filter_by(a, m)) == [(1, 1), (2, None)]
    assert rows(st.dropna(a)) == [(1, 1), (3, 3), (4, 4)]
    assert rows(st.delay(a, 10)) == [(11, 1), (12, None), (13, 3), (14, 4)]
    both = st.combine_latest(a, m)
    assert rows(st.select(both, 1)) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    with pytest.raises(IndexError):
        st.select(both, -1)
    with pytest.raises(KeyError):
        st.select(both, "zz")


def test_merge_and_split(spark):
    a, b = stream(spark, [1, 3, 3], [1, 2, 3], "a"), stream(spark, [1, 2, 3], [7, 8, 9], "b")
    merged = st.merge(a, b)
    assert [(r.ts, r.source, r.a) for r in merged.collect()] == [(1, 0, 1), (1, 1, 7), (2, 1, 8), (3, 0, 2), (3, 0, 3), (3, 1, 9)]
    assert [(r.ts, r.a) for r in st.split(merged, 2)[1].orderBy("ts").collect()] == [(1, 7), (2, 8), (3, 9)]
    with pytest.raises(ValueError):
        st.split(merged, 1)


def test_resample_by_index(spark):
    s = stream(spark, [0, 3, 10, 12, 20], [1, 2, 3, 4, 5])
    assert rows(st.resample(s, "last", freq=10)) == [(0, 2), (10, 4), (20, 5)]
    s = stream(spark, [0, 3, 10, 12], [1, 2, 3, 4])
    assert rows(st.resample(s, "sum", freq=10, label="right")) == [(10, 3), (20, 7)]
    s = stream(spark, [2, 7, 12], [1, 2, 3])
    assert rows(st.resample(s, "first", freq=5, origin=2)) == [(2, 1), (7, 2), (12, 3)]
    s = stream(spark, [-1, 1, 31], [1, None, 3])
    assert rows(st.resample(s, "mean", freq=10)) == [(-10, 1), (0, None), (30, 3)]
    assert rows(st.resample(s, "sum", freq=10, fill="nan")) == [(-10, 1), (0, 0), (10, None), (20, None), (30, 3)]
    assert rows(st.resample(s, "count", freq=10, fill="carry")) == [(-10, 1), (0, 0), (10, 0), (20, 0), (30, 1)]


def test_information_bars(spark):
    df = spark.createDataFrame([(i, float(p), float(v)) for i, (p, v) in enumerate(zip([10, 11, 12, 13, 14, 15], [4, 3, 5, 2, 6, 1], strict=True))], "ts long, p double, v double")
    bars = st.resample(Stream(df, "ts", ["p", "v"]), "ohlc", threshold=5, driver="v")
    assert rows(bars, "open", "high", "low", "close")[:2] == [(0, 10, 11, 10, 11), (2, 12, 12, 12, 12)]
    assert rows(st.resample(stream(spark, range(5), [1, None, 3, 4, 5]), "sum", count=2, label="right")) == [(1, 1), (3, 7), (4, 5)]


def test_clock(spark):
    v, clock = stream(spark, [0, 2, 4, 6], [10, 20, 30, 40]), stream(spark, [1, 3, 5], [0, 0, 0], "c")
    assert rows(st.resample(v, "last", clock=clock, fill="carry")) == [(1, 10), (3, 20), (5, 30)]
    late = stream(spark, [2, 2, 9, 30], [0, 0, 0, 0], "c")
    assert rows(st.resample(v, "sum", clock=late)) == [(2, 30), (9, 70)]
    assert rows(st.resample(v, "sum", clock=late, fill="nan")) == [(2, 30), (9, 70), (30, None)]
    assert rows(st.resample(v, "last", clock=late, fill="carry", max_age=5)) == [(2, 20), (9, 40), (30, None)]


def test_operator_as_aggregate(spark):
    s = stream(spark, range(10), [0] * 5 + [0, 1, 2, 3, 4])
    assert [r[1] for r in rows(st.resample(s, tw.ops.ExpandingSkew(), count=5))] == [None, 0.0]


def test_what_is_refused(spark):
    s = stream(spark, [1], [1])
    for kw in ({}, {"freq": 1, "count": 2}, {"freq": 1, "fill": "zero"}, {"freq": 1, "max_age": 3}):
        with pytest.raises(ValueError):
            st.resample(s, "last", **kw)
    with pytest.raises(TypeError):
        st.resample(s, {"v": "last"}, freq=1)
    with pytest.raises(ValueError):
        st.micros("1M")
    with pytest.raises(ValueError):
        Stream(spark.createDataFrame([(1.5, 2.0)], "ts double, v double"), "ts", "v")


def test_positional_zip_and_pairs(spark):
    x, y = stream(spark, range(5), [1, 2, 3, 4, 5], "x"), stream(spark, range(5), [10, 20, 30, 40, 50], "y")
    assert rows(st.forecast_pairs(x, y, count=2)) == [(0, None, 10), (1, None, 20), (2, 1, 30), (3, 2, 40), (4, 3, 50)]
    assert rows(st.forecast_pairs(x, y, duration=2, drop=True)) == [(2, 1, 30), (3, 2, 40), (4, 3, 50)]
    with pytest.raises(ValueError):
        st.zip_streams(x, stream(spark, range(4), [1, 2, 3, 4], "z"))


def test_pipeline_round_trip(spark):
    a, b = source("a"), source("b")
    mean = apply(tw.ops.RollingMean(2), a)
    graph = Pipeline([a, b], {"beta": apply(tw.ops.Sub(), mean, b), "bars": flow("resample", flow("filter_by", a, b), agg=tw.ops.ExpandingMean(), freq=3), "late": flow("delay", flow("dropna", a), duration=1)})
    feeds = {"a": stream(spark, [1, 2, 3, 4], [1, 3, None, 5], "x"), "b": stream(spark, [1, 3], [1, 2], "y")}
    want = {k: rows(s) for k, s in graph(**feeds).items()}
    assert want["beta"] == [(1, None), (2, 1.0), (3, None), (4, 2.0)]
    again = Pipeline.from_json(graph.to_json())
    assert {k: rows(s) for k, s in again(**feeds).items()} == want
    assert json.loads(again.to_json()) == json.loads(graph.to_json())
    assert "RollingMean(window_size=2)" in graph.to_text() and graph.to_dot().startswith("digraph")
    assert set(graph.aligned(**feeds).columns) >= {"ts", "beta_value", "late_x"}
    with pytest.raises(ValueError):
        Pipeline([a, b], {"m": mean})
    with pytest.raises(ValueError):
        Pipeline([a], {"m": apply(tw.ops.Sub(), a, b)})
    with pytest.raises(ValueError):
        flow("merge", a, b)


def test_sources(spark, tmp_path):
    s = frames.from_arrays(spark, np.array([[1.0, 2.0], [np.nan, 4.0]]))
    assert rows(s) == [(0, 1, 2), (1, None, 4)]
    back = frames.to_pandas(s)
    assert back.shape == (2, 2) and back.index.tolist() == [0, 1]
    p = frames.from_pandas(spark, pd.Series([1.0, 2.0], index=pd.to_datetime(["2024-01-01", "2024-01-02"]), name="px"))
    assert p.values == ["px"] and p.timed
    frames.to_parquet(s, str(tmp_path / "s"))
    assert rows(frames.from_parquet(spark, str(tmp_path / "s"), "ts", ["c0", "c1"])) == rows(s)
