"""Counting and picking curve points by score bucket, a batch of evaluation rows at a time.

A row is a point on the curve of every class, so the score vectors of a batch
are taken as one matrix; the points themselves become rows only where they are
picked. Buckets follow the curve order from its end: 0 to 4,095 for negative
scores, then the image buckets of the rows scored exactly zero, then positive scores.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from detframe.functions.scores import conform

# Score buckets above and below zero, and image buckets of the rows scored exactly zero (for keys that are no numbers: marks between buckets).
SCORE_BUCKETS = 4096
TIE_BUCKETS = 256
TIE_MARKS = 63
ZERO = SCORE_BUCKETS + 1
POSITIVE = ZERO + TIE_BUCKETS
SLOTS = POSITIVE + SCORE_BUCKETS
# Counters a task holds before it hands them on.
HELD = 1 << 25
# Points made of evaluation rows at once.
MADE = 1 << 19


def _slots(scores: np.ndarray, nulls: np.ndarray | None, tie: np.ndarray, low: float, high: float) -> np.ndarray:
    """Order-keeping bucket of each entry of the matrix: by score, for zero by the image's bucket."""
    out = np.broadcast_to((ZERO + tie)[:, None], scores.shape).astype(np.int32)
    for chosen, end, first, step in ((scores < 0, low, ZERO - 1, -1), ((scores > 0) | np.isnan(scores), high, POSITIVE, 1)):
        if chosen.any():
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                place = np.floor(scores[chosen] / end * (SCORE_BUCKETS - 1))
            out[chosen] = first + step * np.clip(np.nan_to_num(place), 0, SCORE_BUCKETS - 1).astype(np.int32)
    if nulls is not None:
        out[nulls] = 0
    return out


def _groups(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each run in a batch."""
    codes, values = np.zeros(batch.num_rows, dtype=np.int64), [()]
    for name in by:
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        own = column.dictionary.to_pylist()
        codes = codes * len(own) + column.indices.to_numpy(zero_copy_only=False)
        values = [(*v, o) for v in values for o in own]
    for code in np.unique(codes):
        yield values[code], batch if len(values) == 1 else batch.filter(pa.array(codes == code))


def _pieces(batch: pa.RecordBatch, classes: int) -> Iterator[pa.RecordBatch]:
    """The batch a few rows at a time, so that a wide vector does not make many points at once."""
    step = max(1, MADE // classes)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _vectors(found: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray | None]:
    flat = found.column("scores").flatten()
    nulls = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, classes) if flat.null_count else None
    return flat.to_numpy(zero_copy_only=False).reshape(-1, classes), nulls


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _prepared(rows: DataFrame, classes: int, tie: Column, columns: list[str]) -> DataFrame:
    vector = F.when(F.col("kind") == 0, conform(F.col("scores"), classes))
    target = F.coalesce(F.col("y_true").cast("int"), F.lit(-1))
    return rows.select(*[c for c in columns if c != "kind"], "kind", target.alias("y_true"), tie.cast("int").alias("_tie"), vector.alias("scores"))


def count_buckets(rows: DataFrame, classes: int, tie: Column, low: float, high: float, by=()) -> DataFrame:
    """``n`` points and ``t`` hits of each class and bucket that has any."""
    by = list(by)
    size = classes * SLOTS

    def counted(batches):
        held, kinds = {}, []

        def parts():
            for key, (n, t) in held.items():
                at = np.flatnonzero(n)
                own = [pa.array([v] * len(at), type=kind) for v, kind in zip(key, kinds)]
                numbers = [pa.array((at // SLOTS).astype(np.int32)), pa.array((at % SLOTS).astype(np.int32)), pa.array(n[at]), pa.array(t[at])]
                yield pa.RecordBatch.from_arrays([*own, *numbers], names=[*by, "class_id", "slot", "n", "t"])

        for batch in batches:
            kinds = [batch.schema.field(name).type for name in by]
            for key, part in _groups(batch, by):
                if key not in held:
                    held[key] = (np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64))
                n, t = held[key]
                at = _slots(*_vectors(part, classes), _ints(part, "_tie"), low, high) + np.arange(classes) * SLOTS
                n += np.bincount(at.ravel(), minlength=size)
                target = _ints(part, "y_true")
                hit = np.flatnonzero((target >= 0) & (target < classes))
                t += np.bincount(at[hit, target[hit]], minlength=size)
                if len(held) * size * 2 > HELD:
                    yield from parts()
                    held.clear()
        yield from parts()

    schema = StructType([
        *[rows.schema[name] for name in by], StructField("class_id", IntegerType()), StructField("slot", IntegerType()),
        StructField("n", LongType()), StructField("t", LongType()),
    ])
    found = _prepared(rows.where(F.col("kind") == 0), classes, tie, by).mapInArrow(counted, schema)
    # A missed box has the same bucket on the curves of all classes, so those are counted before they are spread.
    place = (tie + ZERO).cast("int").alias("slot")
    every = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    missed = rows.where(F.col("kind") == 1).groupBy(*by, "y_true", place).agg(F.count("*").alias("n")).withColumn("class_id", every)
    hits = F.when(F.col("y_true") == F.col("class_id"), F.col("n")).otherwise(0).cast("bigint")
    both = found.unionByName(missed.select(*by, "class_id", "slot", "n", hits.alias("t")))
    return both.groupBy(*by, "class_id", "slot").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def points_in(
    rows: DataFrame, classes: int, tie: Column, low: float, high: float, chosen: dict[tuple, np.ndarray], by=(), keep=("image_id", "kind", "det_score", "pos"),
) -> DataFrame:
    """The points of detections in the ``chosen`` buckets (per run: sorted ``class * SLOTS + slot``), with ``class_id, slot, score, hit``."""
    by, keep = list(by), list(keep)
    names = [*by, *keep, "class_id", "slot", "score", "hit"]

    def picked(batches):
        masks = {}
        for key, codes in chosen.items():
            masks[key] = np.zeros(classes * SLOTS, dtype=bool)
            masks[key][codes] = True

        for batch in batches:
            for key, part in _groups(batch, by):
                if key not in masks:
                    continue
                mask = masks[key]
                for piece in _pieces(part, classes):
                    scores, nulls = _vectors(piece, classes)
                    slot = _slots(scores, nulls, _ints(piece, "_tie"), low, high)
                    code = slot + np.arange(classes) * SLOTS
                    row, class_id = np.nonzero(mask[code])
                    # bucket by bucket: neighbours are alike, so they pack well where they are shuffled
                    near = np.argsort(code[row, class_id], kind="stable")
                    row, class_id = row[near], class_id[near]
                    taken, place = piece.take(pa.array(row)), pa.array(row * classes + class_id)
                    hit = (_ints(taken, "y_true") == class_id).astype(np.int64)
                    own = [taken.column(name) for name in (*by, *keep)]
                    numbers = [pa.array(class_id.astype(np.int32)), pa.array(slot[row, class_id]), piece.column("scores").flatten().take(place), pa.array(hit)]
                    yield pa.RecordBatch.from_arrays([*own, *numbers], names=names)

    fields = [rows.schema[name] for name in (*by, *keep)]
    schema = StructType([
        *fields, StructField("class_id", IntegerType()), StructField("slot", IntegerType()), StructField("score", DoubleType()),
        StructField("hit", LongType()),
    ])
    return _prepared(rows.where(F.col("kind") == 0), classes, tie, [*by, *keep]).mapInArrow(picked, schema)


def missed_in(rows: DataFrame, tie: Column, buckets: DataFrame, by=(), keep=("image_id", "kind", "det_score", "pos")) -> DataFrame:
    """The same for missed boxes, scored zero on every curve: joined to the zero buckets among ``buckets`` (a bounded table)."""
    zero = buckets.where(F.col("slot").between(ZERO, ZERO + TIE_BUCKETS - 1)).select(*by, "class_id", "slot")
    missed = rows.where(F.col("kind") == 1).withColumn("slot", (tie + ZERO).cast("int")).join(zero, [*by, "slot"])
    hit = (F.col("y_true") == F.col("class_id")).cast("bigint")
    return missed.select(*by, *keep, "class_id", "slot", F.lit(0.0).alias("score"), hit.alias("hit"))


def zero_rows(rows: DataFrame, classes: int, by=(), keep=("image_id", "kind", "det_score", "pos")) -> DataFrame:
    """Rows scored exactly zero for some class, with these classes as ``zero``; missed boxes, zero for all, hold NULL there."""
    vector = conform(F.col("scores"), classes)
    places = F.filter(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.get(vector, i) == 0.0)
    zero = F.when(F.col("kind") == 0, places)
    target = F.coalesce(F.col("y_true").cast("int"), F.lit(-1))
    return rows.select(*by, *keep, target.alias("y_true"), zero.alias("zero")).where(F.col("zero").isNull() | (F.size("zero") > 0))


def count_zeros(rows: DataFrame, classes: int, by=()) -> DataFrame:
    """``n`` points and ``t`` hits of each class among ``zero_rows``, for each value of ``by``."""
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    missed = rows.where(F.col("zero").isNull()).groupBy(*by, "y_true").agg(F.count("*").alias("n"))
    missed = missed.select(*by, "y_true", F.explode(every).alias("class_id"), "n")
    found = rows.where(F.col("zero").isNotNull()).select(*by, "y_true", F.explode("zero").alias("class_id"), F.lit(1).cast("bigint").alias("n"))
    hits = F.when(F.col("y_true") == F.col("class_id"), F.col("n")).otherwise(0).cast("bigint")
    return missed.unionByName(found).groupBy(*by, "class_id").agg(F.sum("n").alias("n"), F.sum(hits).alias("t"))


def zero_points(rows: DataFrame, classes: int, by=(), keep=("image_id", "kind", "det_score", "pos")) -> DataFrame:
    """The points of ``zero_rows`` with ``class_id, hit`` and, counted within each value of ``by``, ``_rank, _tp`` up to each.

    The rows of a value lie in one partition in curve order; a task holds one counter of a class and value.
    """
    by, keep = list(by), list(keep)
    names = [*by, *keep, "class_id", "hit", "_rank", "_tp"]

    def spread(batches):
        upto = {}
        for batch in batches:
            for key, part in _groups(batch, by):
                for piece in _pieces(part, classes):
                    zero = piece.column("zero")
                    flags = np.repeat(zero.is_null().to_numpy(zero_copy_only=False)[:, None], classes, axis=1)
                    flags[pc.list_parent_indices(zero).to_numpy(), zero.flatten().to_numpy()] = True
                    hits = flags & (_ints(piece, "y_true")[:, None] == np.arange(classes))
                    n, t = upto.get(key, (0, 0))
                    rank, tp = np.cumsum(flags, axis=0, dtype=np.int64) + n, np.cumsum(hits, axis=0, dtype=np.int64) + t
                    upto[key] = (rank[-1].copy(), tp[-1].copy())
                    row, class_id = np.nonzero(flags)
                    taken = piece.take(pa.array(row))
                    own = [taken.column(name) for name in (*by, *keep)]
                    at = (row, class_id)
                    numbers = [pa.array(class_id.astype(np.int32)), pa.array(hits[at].astype(np.int64)), pa.array(rank[at]), pa.array(tp[at])]
                    yield pa.RecordBatch.from_arrays([*own, *numbers], names=names)

    fields = [rows.schema[name] for name in (*by, *keep)]
    schema = StructType([*fields, StructField("class_id", IntegerType()), *[StructField(n, LongType()) for n in ("hit", "_rank", "_tp")]])
    return rows.mapInArrow(spread, schema)


# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
