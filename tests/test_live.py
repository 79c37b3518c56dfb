import numpy as np
import pandas as pd
import pytest

import tidewater as tw
from tidewater.sources.frames import read_stream
from tidewater.streaming.live import live_kernels, live_windows

SCHEMA = "k string, i long, x double"


def write(tmp_path, spark, frame, parts):
    for n, part in enumerate(np.array_split(np.arange(len(frame)), parts)):
        spark.createDataFrame(frame.iloc[part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        yield n


def data():
    rng = np.random.default_rng(4)
    f = pd.DataFrame({"k": rng.choice(list("ab"), 120), "i": np.arange(120), "x": rng.normal(size=120)})
    f.loc[::9, "x"] = None
    return f


def test_kernels_keep_their_state(spark, tmp_path):
    frame, nodes = data(), {"e": tw.ops.EwMean(alpha=0.3)("x"), "s": tw.ops.SuperSmoother(period=8.0)("x")}
    got = []
    for _ in write(tmp_path, spark, frame, 3):
        q = live_kernels(read_stream(spark, str(tmp_path / "in"), SCHEMA), "k", ["i"], nodes).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    want = tw.series(spark.createDataFrame(frame, SCHEMA), "k", "i").select("k", "i", **nodes).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    assert len(got) == 120
    for c in nodes:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)


def test_windows_reach_back_over_batches(spark, tmp_path):
    frame, nodes = data(), {"m": tw.ops.RollingMean(4)("x"), "d": tw.ops.Diff(2)("x")}
    out = []
    batch = None
    for _ in write(tmp_path, spark, frame, 4):
        df = read_stream(spark, str(tmp_path / "in"), SCHEMA)
        batch = live_windows(df, ["k"], ["i"], nodes, 12, str(tmp_path / "tail"), lambda d, n: out.append(d.toPandas()))
        q = df.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = pd.concat(out).sort_values(["k", "i"]).reset_index(drop=True)
    want = tw.series(spark.createDataFrame(frame, SCHEMA), "k", "i").select("k", "i", **nodes).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    assert len(got) == 120
    for c in nodes:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)


def test_graphs_of_operators_run_live(spark, tmp_path):
    x = "x"
    macd, stoch = tw.ops.MACD(3, 7, 4)(x), tw.ops.StochRSI(5, 6, 2, 3)(x)
    nodes = {"m": macd["hist"], "st": stoch["k"], "t": tw.ops.TRIX(4)(x), "h": tw.ops.HullMA(9)(x), "d": tw.ops.Sub()(x, tw.ops.RollingMedian(5)(tw.ops.EwMean(alpha=0.5)(x))), "r": tw.ops.RollingCorr(8)(x, "y"), "a": tw.ops.ATR(4)("y", x, x), "x2": tw.ops.Linear(2.0)(x)}
    schema = SCHEMA + ", y double"
    frame = data()
    frame["y"] = np.random.default_rng(5).normal(size=len(frame))
    for part in np.array_split(np.arange(len(frame)), 4):
        spark.createDataFrame(frame.iloc[part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live_kernels(read_stream(spark, str(tmp_path / "in"), schema), "k", ["i"], nodes).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    want = tw.series(spark.createDataFrame(frame, schema), "k", "i").select("k", "i", **nodes).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    assert len(got) == len(want) == 120
    for c in nodes:
        assert want[c].notna().sum() > 20, c
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)
    with pytest.raises(ValueError):
        live_kernels(read_stream(spark, str(tmp_path / "in"), schema), "k", ["i"], {"n": tw.ops.CumProd()(x)})


def test_late_rows(spark, tmp_path):
    parts = [[("a", 1, 1.0), ("a", 5, 2.0)], [("a", 3, 9.0), ("a", 6, 4.0), ("b", 2, 1.0)]]
    for n, late in enumerate(("drop", "fail")):
        here = tmp_path / late
        for p in parts:
            spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(str(here / "in"))
            q = live_kernels(read_stream(spark, str(here / "in"), SCHEMA), "k", ["i"], {"s": tw.ops.EwMean(alpha=0.5)("x")}, late=late).writeStream.outputMode("append").option("checkpointLocation", str(here / "cp")).format("parquet").option("path", str(here / "out")).trigger(availableNow=True).start()
            if n and p is parts[1]:
                with pytest.raises(Exception, match="came after later ones"):
                    q.awaitTermination()
            else:
                q.awaitTermination()
    got = [(r.k, r.i) for r in spark.read.parquet(str(tmp_path / "drop" / "out")).orderBy("k", "i").collect()]
    assert got == [("a", 1), ("a", 5), ("a", 6), ("b", 2)]
