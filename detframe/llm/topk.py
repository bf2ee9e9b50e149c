"""Exact top-k by inner product with vector-approximation files.

Each component is an integer; a vector's approximation keeps the cell of each component (``CELL_BITS`` bits fewer), so a query
bounds the score of every vector from the cells alone. The cells are scanned block by block for all queries; a block keeps what can
still be among its best. Then exact vectors are read in the order of their upper bounds: the first ``FIRST_READ`` of each query
give a score that k vectors reach for certain, and of the rest only those are read whose bound is not below it.

Equal vectors are one vector with the smallest ids that hold it, so a vector that a third of the rows share is scanned once.

Defined cases: vectors that are null, or hold a null, a NaN or an infinite component, take no part; ties go to the smaller id; a
query never meets rows of its own id; rows that repeat id and vector are one row; an id with several vectors asks once for each of
them; fewer candidates than k give all of them; vectors of different lengths never meet. Components count up to 64 bits (beyond,
the nearest such integer); scores are exact, and where one does not fit 64 bits the nearest such integer is given, ranks staying exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detframe.llm.common import stored

K, SCALE, QUERY_STEP = 5, 256, 50
CELL_BITS = 2
BLOCK_ROWS, QUERY_ROWS, FIRST_READ = 16_384, 16_384, 32


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``, the components as floor(256 * x); rows that take no part are left out."""
    real = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return vectors.filter(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(real, _integer).alias("v"))


def _integer(x: Column) -> Column:
    """floor(256 * x), held within 64 bits."""
    scaled, most = F.lit(float(SCALE)) * x, float(2**63)
    return F.when(scaled >= most, F.lit(2**63 - 1)).when(scaled < -most, F.lit(-(2**63))).otherwise(F.floor(F.when(F.abs(scaled) < most, scaled).otherwise(0.0)))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``v`` and ``ids``, the k + 1 smallest ids that hold it (one may be the query's own).

    A batch leaves only these for each vector it holds before rows are shuffled, and a common vector is then gathered in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, set[int]] = {}
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(tuple(vector), set()).add(vec_id)
            ids = [sorted(x)[: k + 1] for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(map(list, held), pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.int64()))], ["v", "ids"])

    kept = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    part = F.pmod(F.xxhash64("ids"), F.lit(64))
    met = rows.select("vec_id", "v").mapInArrow(run, "v array<long>, ids array<long>")
    return met.groupBy("v", part.alias("part")).agg(kept.alias("ids")).groupBy("v").agg(kept.alias("ids"))


def bounds(queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries (rows) with vectors known by their cells (rows)."""
    low = (cells.astype(np.float64)) * (1 << CELL_BITS)
    width = float((1 << CELL_BITS) - 1)
    base = queries @ low.T
    up = np.maximum(queries, 0).sum(1) * width
    down = np.minimum(queries, 0).sum(1) * width
    # what rounding can move, far below 1 unless components are huge
    slack = 1e-12 * np.abs(queries).sum(1) * (np.abs(low).max(initial=0.0) + width)
    return base + (down - slack)[:, None], base + (up + slack)[:, None]


def candidates(queries: DataFrame, cells: DataFrame, enough: int) -> DataFrame:
    """``query``, ``node``, ``copies`` and ``upper`` of what can be among the best of its block, with ``least``, a score that ``enough``
    rows of the block are certain to reach."""

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({n: pd.Series(dtype=t) for n, t in (("query", "int64"), ("node", "int64"), ("copies", "int64"), ("upper", "float64"), ("least", "float64"))})]
        lengths = right["cells"].map(len)
        for size, own in left.groupby(left["v"].map(len)):
            vectors = right[lengths == size]
            if not len(vectors) or not size:
                continue
            data, held, nodes = np.stack(vectors["cells"].to_list()), vectors["copies"].to_numpy(), vectors["node"].to_numpy()
            for begin in range(0, len(own), 64):
                part = own.iloc[begin : begin + 64]
                lower, upper = bounds(np.stack(part["v"].to_list()).astype(np.float64), data)
                for low, up, query in zip(lower, upper, part["query"]):
                    best = np.argpartition(-low, enough - 1)[:enough] if low.size > enough else np.arange(low.size)
                    best = best[np.argsort(-low[best])]
                    reached = np.cumsum(held[best]) >= enough
                    least = low[best[np.argmax(reached)]] if reached.any() else -np.inf
                    keep = np.flatnonzero(up >= least)
                    out.append(pd.DataFrame({"query": query, "node": nodes[keep], "copies": held[keep], "upper": up[keep], "least": least}))
        return pd.concat(out)

    # every block of queries meets every block of vectors in one tile
    parts, blocks = (max(1, -(-x.count() // n)) for x, n in ((queries, QUERY_ROWS), (cells, BLOCK_ROWS)))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    known = cells.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asked.groupBy("part", "block").cogroup(known.groupBy("part", "block")).applyInPandas(
        scan, "query long, node long, copies long, upper double, least double"
    )


def exact(wanted: DataFrame, queries: DataFrame, vectors: DataFrame, wide: bool) -> DataFrame:
    """``wanted`` (``query``, ``node``) with the vectors' ids and the exact scores; ``wide``: products may leave 64 bits."""
    kind = "decimal(38,0)" if wide else "long"
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast(kind) * b), F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))
    return wanted.join(vectors.select("node", "v", "ids"), "node").join(queries.select("query", "query_id", F.col("v").alias("q")), "query").select(
        "query", "query_id", "node", "copies", "ids", score.alias("score")
    )


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row whose id is divisible by ``step`` its k best other rows."""
    rows = stored(integers(vectors), "integers")
    known = stored(distinct_vectors(rows, k).withColumn("node", F.monotonically_increasing_id()), "vectors")
    asking = rows.filter(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates()
    queries = stored(asking.withColumn("query", F.monotonically_increasing_id()), "queries")
    # of the rows that lie above what is left out, as many as one id has vectors may be the query's own
    own = known.select(F.explode("ids").alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    enough = k + own
    length = known.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    wide = (length[0] or 0) * (length[1] or 0.0) ** 2 >= 2.0**62
    cells = known.select("node", F.size("ids").cast("long").alias("copies"), F.transform("v", lambda x: F.shiftright(x, CELL_BITS)).alias("cells"))
    found = stored(candidates(queries.select("query", "v"), cells, enough), "candidates")
    least = found.groupBy("query").agg(F.max("least").alias("sure"))
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "node")
    left = stored(found.join(least, "query").filter(F.col("upper") >= F.col("sure")).withColumn("turn", F.row_number().over(order)).drop("least", "sure"), "candidates")
    first = stored(exact(left.filter(F.col("turn") <= FIRST_READ).select("query", "node", "copies"), queries, known, wide), "exact")
    others = F.size(F.filter("ids", lambda x: x != F.col("query_id")))
    reached = F.sum(others).over(Window.partitionBy("query").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    certain = first.withColumn("reached", reached).filter(F.col("reached") >= k).groupBy("query").agg(F.max("score").cast("double").alias("certain"))
    rest = left.filter(F.col("turn") > FIRST_READ).join(certain, "query", "left").filter(
        F.col("certain").isNull() | (F.col("upper") >= F.col("certain") - F.abs("certain") * 1e-12)
    )
    scored = first.unionByName(exact(rest.select("query", "node", "copies"), queries, known, wide))
    each = scored.select("query", "query_id", "score", F.explode("ids").alias("vec_id")).filter(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    limits = (F.lit(2**63 - 1).cast("decimal(38,0)"), F.lit(-(2**63)).cast("decimal(38,0)"))
    shown = F.greatest(F.least(F.col("score"), limits[0]), limits[1]).cast("long") if wide else F.col("score")
    return each.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", shown.alias("score"))
