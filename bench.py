"""Times headline queries on one machine and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8). Each query is run
once to warm up and then timed over a full evaluation of all its columns (a no-op write)."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import tidewater as tw  # noqa: E402
from tidewater.operators.streams import Stream, combine_latest, resample  # noqa: E402


def lines(spark, sf):
    """Two-input series of 600,000 x SF rows in many keys."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    return tw.series(df, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])


def ticks(spark, sf, kind=None):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e if kind is None else e.where(F.col("event_type") == kind)
    return Stream(e.select("user_id", "ts", "event_id", F.col("value").alias("x" if kind is None else kind)), "ts", "x" if kind is None else kind, "user_id", "event_id")


QUERIES = {
    "expressions": lambda s, d: lines(s, d).select(a=tw.ops.Log()("price"), b=tw.ops.Sigmoid()("qty"), c=tw.ops.Hypot()("price", "qty"), d=tw.ops.Clip(10.0, 40.0)("qty")),
    "rolling_statistics": lambda s, d: lines(s, d).select(a=tw.ops.RollingMean(100)("price"), b=tw.ops.RollingStd(100)("price"), c=tw.ops.RollingMin(100)("price"), d=tw.ops.RollingMax(100)("price"), e=tw.ops.RollingSkew(100)("price")),
    "rolling_order_statistics": lambda s, d: lines(s, d).select(a=tw.ops.RollingMedian(100)("price"), b=tw.ops.RollingQuantile(100, 0.9)("price")),
    "rolling_regression": lambda s, d: lines(s, d).select(a=tw.ops.RollingBeta(50)("price", "qty"), b=tw.ops.RollingCorr(50)("price", "qty")),
    "ew_kernels": lambda s, d: lines(s, d).select(a=tw.ops.EwMean(span=20)("price"), b=tw.ops.EwStd(span=20)("price"), c=tw.ops.EwBeta(span=20)("price", "qty")),
    "sequential_kernels": lambda s, d: lines(s, d).select(a=tw.ops.RollingRSI(14)("price"), b=tw.ops.KAMA(10)("price"), c=tw.ops.Butter(2, 0.1)("price")),
    "robust_kernel": lambda s, d: lines(s, d).select(a=tw.ops.Hampel(50)("price")),
    "cumulative": lambda s, d: lines(s, d).select(a=tw.ops.CumSum()("price"), b=tw.ops.MaxDrawdown()("price"), c=tw.ops.ExpandingStd()("qty")),
    "as_of_join": lambda s, d: combine_latest(ticks(s, d, "click"), ticks(s, d, "view")).df,
    "resample_bars": lambda s, d: resample(ticks(s, d), "ohlc", freq="h").df,
    "clock_as_of": lambda s, d: resample(ticks(s, d, "click"), "last", clock=ticks(s, d, "view"), fill="carry").df,
}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in QUERIES.items():
        for _ in range(2):
            began = time.perf_counter()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")), "lineitem_rows": rows, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
