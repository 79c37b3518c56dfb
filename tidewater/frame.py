"""A frame of series: a DataFrame with the columns that tell series apart and those that order each one."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .plans.node import Node, lower


class Series:
    """Rows of any number of series. `key` columns name the series, `order` columns order it totally."""

    def __init__(self, df: DataFrame, key: list[str] | str = (), order: list[str] | str = ()) -> None:
        self.df = df
        self.key = [key] if isinstance(key, str) else list(key)
        self.order = [order] if isinstance(order, str) else list(order)
        for c in (*self.key, *self.order):
            if c not in df.columns:
                raise ValueError(f"the frame has no column {c}")
        if not self.order:
            raise ValueError("a series needs an order")

    def with_columns(self, **outputs: Node | str) -> Series:
        """The frame and the nodes' values as further columns."""
        return Series(lower(self.df, self.key, self.order, outputs), self.key, self.order)

    def select(self, *columns: str, **outputs: Node | str) -> DataFrame:
        """Some columns of the frame and the nodes' values."""
        keep = [*dict.fromkeys([*self.key, *self.order, *columns])]
        inputs = {i.name for n in outputs.values() if isinstance(n, Node) for i in _leaves(n)} | {n for n in outputs.values() if isinstance(n, str)}
        return lower(self.df.select(*keep, *sorted(inputs - set(keep))), self.key, self.order, outputs, columns=list(columns)).select(*columns, *outputs)


    def in_pieces(self, memory: int, pieces: int, **outputs: Node | str) -> DataFrame:
        """The frame and the nodes' values, for operators of finite memory, with series of any length cut into pieces, so
        that no task has to walk a hot key alone.

        The first order column is cut at quantiles of all rows, which fixes a row's piece by its value alone. A piece
        that continues a series gets the last `memory` rows before it as well; those rows only feed the windows and are
        dropped again. `memory` is how many rows back the nodes reach in all: the sum of window sizes along the longest
        chain, and more where missing values are common, as frames count valid rows. Nodes that need the whole past are
        refused. Only the cuts reach the driver."""
        key, piece, df = self.key, "_tw_piece", self.df
        at = _number(df, self.order[0])
        cuts = df.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 100 * pieces)).first()[0] if pieces > 1 else None
        edges = np.unique(np.array(cuts or [], float))

        @pandas_udf(LongType())
        def placed(x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, x.to_numpy(float), side="right"))

        own = df.withColumn(piece, placed(at))
        group = [*key, piece]
        # rows of each piece, and the pieces after it that reach back into it: each has a row at least, so no further
        # than `memory` pieces on
        counts = own.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        by = Window.partitionBy(*key).orderBy(piece)
        counts = counts.withColumn("before", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
        later = F.collect_list(F.struct(F.col(piece).alias("to"), F.col("before").alias("start"))).over(by.rowsBetween(1, memory))
        end = F.col("before") + F.col("n")
        feeds = counts.withColumn("later", later).select(*group, end.alias("end"), F.explode("later").alias("x")).select(*group, F.col("x.to").alias("_tw_to"), (F.lit(memory) - (F.col("x.start") - F.col("end"))).alias("_tw_rows")).where("_tw_rows > 0")
        last = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in self.order])
        tails = own.withColumn("_tw_n", F.row_number().over(last)).where(F.col("_tw_n") <= memory)
        same = [tails[c].eqNullSafe(feeds[c]) for c in group]
        given = tails.join(feeds, reduce(lambda p, q: p & q, same)).where(F.col("_tw_n") <= F.col("_tw_rows"))
        given = given.select(*[tails[c] for c in df.columns], F.col("_tw_to").alias(piece), F.lit(False).alias("_tw_own"))
        both = own.withColumn("_tw_own", F.lit(True)).unionByName(given)
        return lower(both, group, self.order, outputs, bounded=True).where("_tw_own").drop(piece, "_tw_own")


def _number(df: DataFrame, column: str) -> Column:
    """A numeric or time column as a double that sorts the same way."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "timestamp_ntz":
        return (c - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)").cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "string":
        raise ValueError("pieces need a numeric or time order")
    return c.cast("double")


def _leaves(n: Node) -> list[Node]:
    return [n] if n.spec is None else [x for i in n.inputs for x in _leaves(i)]


def series(df: DataFrame, key: list[str] | str = (), order: list[str] | str = ()) -> Series:
    return Series(df, key, order)
