"""Connected components of an edge list, by repeated contraction.

Each round gives every vertex the smallest vertex among itself and its neighbours, follows these pointers a few
steps, and contracts the graph to the edges between different targets. A star collapses in one round, so hubs don't
survive; aggregates are combined before they shuffle, and joins read written tables, so that the planner can split
hot keys. Nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root): for each vertex of an edge the smallest vertex that it reaches. Null ends and loops are
    ignored; an empty edge list gives an empty result."""
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    levels: list[DataFrame] = []
    while not e.isEmpty():
        low = (
            e.select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
            .unionAll(e.select(F.col("b").alias("v"), F.least("a", "b").alias("p")))
            .groupBy("v")
            .agg(F.min("p").alias("p"))
        )
        low = cut(low)
        for _ in range(2):
            up = low.select(F.col("v").alias("p"), F.col("p").alias("q"))
            low = cut(low.join(up, "p", "left").select("v", F.least("p", "q").alias("p")))
        levels.append(low)
        to = lambda side: low.select(F.col("v").alias(side), F.col("p").alias("to_" + side))
        e = cut(e.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not levels:
        return e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    out = levels.pop()
    while levels:
        below = levels.pop()
        out = cut(below.join(out.select(F.col("v").alias("p"), F.col("p").alias("r")), "p", "left").select("v", F.coalesce("r", "p").alias("p")))
    return out.select(F.col("v").alias("vertex"), F.col("p").alias("root"))
