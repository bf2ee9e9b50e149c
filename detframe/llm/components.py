"""Connected components of a stored edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of an edge.

    Each round hangs the larger neighbours of every node on its smallest one (large star), then a node and its smaller neighbours
    on the smallest of these (small star). Paths halve, so rounds grow with the logarithm of the longest one; each is written to
    the shared folder. A node with many neighbours is summed up before it is shuffled.
    """
    x, y = F.col(a), F.col(b)
    state = stored(edges.filter(x != y).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).distinct(), "edges")
    while True:
        both = state.unionByName(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = stored(large.filter("u != v").distinct(), "edges")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        next_state = stored(small.select("e.*").filter("u != v").distinct(), "edges")
        same = next_state.exceptAll(state).isEmpty() and next_state.count() == state.count()
        state = next_state
        if same:
            break
    roots = state.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")
    return roots.unionByName(state.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
