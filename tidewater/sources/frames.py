"""Sources and sinks: pandas objects, arrays, files, and collected results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.streams import Stream


def from_pandas(spark: SparkSession, obj: pd.Series | pd.DataFrame, index: str = "ts") -> Stream:
    """A stream from a pandas object; its index becomes the stream's, rows with equal indices keep their order."""
    frame = obj.to_frame("value" if obj.name is None else str(obj.name)) if isinstance(obj, pd.Series) else obj.copy()
    frame.columns = [str(c) for c in frame.columns]
    if frame.index.dtype.kind == "f":
        raise ValueError("a stream's index must be an integer or a timestamp")
    values = list(frame.columns)
    frame.insert(0, "_tw_seq", np.arange(len(frame)))
    frame.insert(0, index, frame.index)
    df = spark.createDataFrame(frame.reset_index(drop=True))
    return Stream(df, index, values, seq="_tw_seq")


def from_arrays(spark: SparkSession, values: np.ndarray, index: np.ndarray | None = None) -> Stream:
    """A stream from an array of values, one column for each column of a matrix; without an index the row number."""
    values = np.asarray(values, float)
    wide = values.reshape(len(values), -1)
    names = ["value"] if values.ndim == 1 else [f"c{i}" for i in range(wide.shape[1])]
    return from_pandas(spark, pd.DataFrame(wide, index=np.arange(len(wide)) if index is None else index, columns=names))


def to_pandas(stream: Stream) -> pd.DataFrame:
    """The stream's values by index; for results that fit the driver."""
    rows = stream.df.orderBy(*stream.key, *stream.order).toPandas()
    return rows.set_index([*stream.key, stream.ts])[stream.values]


def from_parquet(spark: SparkSession, path: str, ts: str, values: list[str], key: list[str] = (), seq: list[str] = ()) -> Stream:
    """A stream from Parquet files; only the named columns are read."""
    return Stream(spark.read.parquet(path), ts, values, key, seq)


def to_parquet(stream: Stream, path: str, mode: str = "errorifexists") -> None:
    stream.df.write.mode(mode).parquet(path)


def read_stream(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Files of a folder as a streaming frame, as they arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(path)
