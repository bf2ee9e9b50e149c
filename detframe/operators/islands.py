"""Islands of a pair table: parts of an image that no pair connects, so each can be settled by itself.

Greedy work inside an image only follows its pairs. An image whose pairs fit one task is one island; a larger one is cut
into its connected components, found by rounds that grow with the logarithm of their width; what is still too large is
handed back. Islands that fit are folded in order at once, however long their chains are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detframe.session import materialize

#: Pairs of an island that one task folds, a few tens of bytes each.
FOLD = 1 << 18

#: Makes the test of an island: whether the next pair of two nodes is accepted.
Rule = Callable[[], Callable[[int, int], bool]]


def _linked(links: DataFrame) -> DataFrame:
    return materialize(links.where("v <> u").distinct(), "links")


def component_roots(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``image_id, node, root`` for all nodes of ``pairs``: the smallest node that pairs lead to within the image.

    Links point from a node to a smaller one. A round hangs what is above a node on its smallest neighbour, then a node and
    what is below it on the smallest of those, until every node has one link and nothing hangs on a node that hangs itself.
    """
    by = ["image_id", "v"]
    links = _linked(pairs.select("image_id", F.greatest(a, b).alias("v"), F.least(a, b).alias("u")))
    while True:
        both = links.unionByName(links.select("image_id", F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(*by).agg(F.min("u").alias("m")).select(*by, F.least("v", "m").alias("m"))
        links = _linked(both.join(least, by).where("u > v").select("image_id", F.col("u").alias("v"), F.col("m").alias("u")))
        low = links.groupBy(*by).agg(F.min("u").alias("m"))
        ends = F.explode(F.array("v", "u")).alias("v")
        links = _linked(links.join(low, by).select("image_id", ends, F.col("m").alias("u")))
        roles = links.select(*by, F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            links.select("image_id", F.col("u").alias("v"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        )
        seen = roles.groupBy(*by).agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if seen.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty():
            break
    own = links.select("image_id", F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return links.select("image_id", F.col("v").alias("node"), F.col("u").alias("root")).unionByName(own)


def split_islands(pairs: DataFrame, a: str, b: str, weight: Column | None = None, fold: int = FOLD) -> tuple[DataFrame, DataFrame | None]:
    """(pairs of islands that fit a task, with their ``island``; pairs of the others, None when there are none).

    ``a`` and ``b`` name the nodes of a pair, ``weight`` says how many pairs it stands for. ``pairs`` should be stored.
    """
    n = F.sum(F.lit(1) if weight is None else weight)
    large = materialize(pairs.groupBy("image_id").agg(n.alias("n")).where(F.col("n") > fold).select("image_id"), "large-images")
    if large.isEmpty():
        return pairs.withColumn("island", F.lit(0).cast("bigint")), None
    whole = pairs.join(large, "image_id", "left_anti").withColumn("island", F.lit(0).cast("bigint"))
    rest = pairs.join(large, "image_id", "left_semi")
    roots = component_roots(rest, a, b).select("image_id", F.col("node").alias(a), F.col("root").cast("bigint").alias("island"))
    named = materialize(rest.join(roots, ["image_id", a]).select(*pairs.columns, "island"), "islands")
    part = ["image_id", "island"]
    giants = materialize(named.groupBy(*part).agg(n.alias("n")).where(F.col("n") > fold).select(*part), "giants")
    small = whole.unionByName(named.join(giants, part, "left_anti"))
    return small, None if giants.isEmpty() else named.join(giants, part, "left_semi").drop("island")


def fold_islands(pairs: DataFrame, order: Sequence[Column], a: str, b: str, rule: Rule) -> DataFrame:
    """The pairs that ``rule`` accepts when those of an island are read in ``order``; many islands a task, one after the other.

    A pair is accepted or not by its nodes ``a`` and ``b`` and what was accepted before; image keys may be of any type.
    """
    place = F.row_number().over(Window.partitionBy("image_id", "island").orderBy(*order))
    placed = pairs.withColumn("_first", place == 1).drop("island")
    return placed.mapInArrow(_accepted(a, b, rule), placed.drop("_first").schema)


def _accepted(a: str, b: str, rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = rule()
        for batch in batches:
            rows = []
            columns = (batch.column(name).to_pylist() for name in ("_first", a, b))
            for row, (first, left, right) in enumerate(zip(*columns)):
                if first:
                    accept = rule()
                if accept(left, right):
                    rows.append(row)
            yield batch.take(pa.array(rows, pa.int64())).drop_columns(["_first"])

    return run


def lost_boxes() -> Callable[[int, int], bool]:
    """Suppression, pairs ``winner, loser`` from the best winner down: the first pair that removes each box."""
    lost: set[int] = set()

    def accept(winner: int, loser: int) -> bool:
        if winner in lost or loser in lost:
            return False
        lost.add(loser)
        return True

    return accept


def taken_boxes() -> Callable[[int, int], bool]:
    """Greedy matches, candidates ``pos, gt_pos`` from the best detection down, its best box first: both must be free."""
    found: set[int] = set()
    boxes: set[int] = set()

    def accept(pos: int, box: int) -> bool:
        if pos in found or box in boxes:
            return False
        found.add(pos)
        boxes.add(box)
        return True

    return accept


cloudpickle.register_pickle_by_value(sys.modules[__name__])
