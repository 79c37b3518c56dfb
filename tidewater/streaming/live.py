"""Operators on Structured Streaming frames.

`live_kernels` runs kernels and graphs of them (MACD, StochRSI, rolling operators in block form, and what links them) with
their state kept by Spark, one state for each key, so a stream gives what a batch over the same rows gives, provided that
each key's rows arrive in order; later arrivals fail or are dropped. `live_windows` runs anything with finite memory (column
expressions and window operators over trailing frames): each micro-batch is computed by the batch engine over the new rows
and, of each key, the last rows that its frames can reach, which are kept in a table of the shared folder. Both expect
rows in order; `watermarked` drops what arrives too late."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.chains import Chain, ported
from ..plans.node import Node, expand, lower


def watermarked(df: DataFrame, ts: str, delay: str = "0 seconds") -> DataFrame:
    return df.withWatermark(ts, delay)


def _jobs(outputs: dict[str, Node]) -> tuple[list, dict[str, str]]:
    """The kernels of all outputs, inputs before their users, and the name of each output's values."""
    names: dict[tuple, list[str]] = {}
    jobs: list[tuple] = []

    def visit(n: Node, of: str) -> str:
        if n.spec is None:
            return n.name
        if n.key not in names:
            if n.spec.kind != "kernel":
                raise ValueError(f"{of}: {n.spec.name} doesn't run on a stream with its past; use live_windows")
            ins = [visit(i, of) for i in n.inputs]
            names[n.key] = [f"_tw{len(names)}_{i}" for i in range(len(n.spec.outputs))]
            jobs.append((n.spec.build, n.params, ins, names[n.key]))
        return names[n.key][n.output]

    return jobs, {name: visit(ported(expand(node), everything=True), name) for name, node in outputs.items()}


def live_kernels(df: DataFrame, key: str, order: list[str], outputs: dict[str, Node], late: str = "fail") -> DataFrame:
    """The streaming frame's rows with the outputs of kernels and of graphs of kernels, in append mode.

    Rows of one micro-batch are put in order. A row that comes before the last one of its key in an earlier batch is late:
    with "fail" the query ends with an error, with "drop" the row is left out, and the state is as if it had not come."""
    if late not in ("fail", "drop"):
        raise ValueError("late must be fail or drop")
    columns = df.columns
    if taken := set(outputs) & set(columns):
        raise ValueError(f"the frame has columns {', '.join(sorted(taken))} already")
    jobs, at = _jobs(outputs)
    read = list(dict.fromkeys(i for _, _, ins, _ in jobs for i in ins if i in columns))
    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in outputs)])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain, last = pickle.loads(state.get[0]) if state.exists else (Chain(jobs), None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable").reset_index(drop=True)
        if last is not None:
            behind = np.array([tuple(r) < last for r in rows[order].itertuples(index=False, name=None)], bool)
            if behind.any() and late == "fail":
                raise ValueError(f"{int(behind.sum())} rows of {key} {group[0]} came after later ones")
            rows = rows[~behind].reset_index(drop=True)
        if len(rows):
            values = chain.run({c: rows[c].to_numpy(float) for c in read}, len(rows))
            last = next(rows[order].tail(1).itertuples(index=False, name=None))
            for name, of in at.items():
                out = pd.Series(values[of] if of in values else rows[of].to_numpy(float))
                rows[name] = out.where(~np.isnan(out), None).astype("Float64")
            state.update((pickle.dumps((chain, last)),))
            yield rows[[*columns, *outputs]]

    return df.groupBy(key).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def live_windows(df: DataFrame, key: list[str], order: list[str], outputs: dict[str, Node], memory: int, tail_path: str, sink):
    """A function for writeStream.foreachBatch: calls sink(frame, batch_id) with the new rows and the nodes' columns.

    `memory` is how many rows back the outputs reach in all: the sum of window sizes along the longest chain, and more
    where missing values are common, as frames count valid rows. Tails are written by batch number, so a batch that is
    run again reads what it read the first time."""
    columns = df.columns
    spark = df.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        old = None
        if number:
            old = spark.read.schema(df.schema).parquet(f"{tail_path}/{number - 1}")
        new = rows.select(*columns).withColumn("_tw_new", F.lit(True))
        both = new if old is None else new.unionByName(old.withColumn("_tw_new", F.lit(False)))
        both = both.persist()
        done = lower(both, key, order, outputs).where("_tw_new").drop("_tw_new")
        sink(done, number)
        last = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
        both.withColumn("_tw_n", F.row_number().over(last)).where(F.col("_tw_n") <= memory).select(*columns).write.mode("overwrite").parquet(f"{tail_path}/{number}")
        both.unpersist()

    return batch
