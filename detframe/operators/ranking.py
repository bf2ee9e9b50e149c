"""Exact order statistics that never put a whole group into one task.

* ``running_totals`` - cumulative sums over a global or per-group order.
* ``exact_quantiles`` - interpolated quantiles from value counts.
* ``column_quantiles`` - the same for many columns of a table, from narrow bands around each quantile.
* ``take_by_hash`` - exactly n rows per group in a uniform hash order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detframe.session import materialize

SLICE = "_slice"


def running_totals(
    df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column], sums: dict[str, Column], label: str = "ordered"
) -> DataFrame:
    """Add, per group and in ``order_by`` order, the sum of each expression up to and including the row.

    The rows are range-partitioned on (group, order), so one hot group or one
    hot value spreads over many slices. Slices are written once, which fixes
    them for every later read; each slice then needs only its own window plus
    the totals of the slices before it (one row per group and slice).
    ``order_by`` must be unique within a group.
    """
    inputs = {f"_in_{name}": expr for name, expr in sums.items()}
    keys = [F.col(g) for g in group_by]
    sliced = materialize(
        df.withColumns(inputs).repartitionByRange(*keys, *order_by).withColumn(SLICE, F.spark_partition_id()),
        label,
    )
    by = [*group_by, SLICE]
    totals = sliced.groupBy(*by).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    before = Window.partitionBy(*(group_by or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    inside = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(offsets, by)
        .withColumns({n: F.sum(f"_in_{n}").over(inside) + F.col(f"_before_{n}") for n in sums})
        .select(*df.columns, *sums)
    )


def ranked(df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column], name: str = "rank") -> DataFrame:
    """Exact row number (from 1) per group, over slices."""
    return running_totals(df, group_by, order_by, {name: F.lit(1).cast("bigint")})


def exact_quantiles(values: DataFrame, group_by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of ``value``: one row per group, one column per entry of ``probs``.

    Equal values are counted first (partial aggregation collapses hot values),
    and the cumulative counts locate the two neighbours of each quantile.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*group_by, value).agg(F.count("*").alias("_n"))
    running = running_totals(counted, group_by, [F.col(value)], {"_upto": F.col("_n")}, "quantiles")
    totals = running.groupBy(*group_by).agg(F.max("_upto").alias("_total"))
    joined = running.join(totals, list(group_by)) if group_by else running.withColumn("_total", totals.scalar())
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)
            picks.append(F.max(F.when(holds, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
    found = joined.groupBy(*group_by).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*group_by, *out)


#: Accuracy of the sketches that place the bands of ``column_quantiles``: a band holds some 8 rows of this many.
ACCURACY = 10_000


def _bands(table: DataFrame, columns: Sequence[str], probs: dict[str, float], accuracy: int) -> list[Column]:
    """For each column and quantile, a struct of the row's value with the bounds of a band that is sure to hold the quantile.

    Sketches propose the bounds, exact counts below and up to them prove that the band holds the wanted places; a band that
    does not is widened. Both passes are one row of partial aggregates; a band as wide as the column always holds.
    """
    todo, bands, slack = [(c, name) for c in columns for name in probs], [], 4 / accuracy
    value = {c: F.col(c).cast("double") for c in columns}
    while todo:
        ends = table.agg(*[
            F.percentile_approx(value[c], [max(0.0, probs[name] - slack), min(1.0, probs[name] + slack)], accuracy)
            for c, name in todo
        ]).first()
        todo = [(c, name, *end) for (c, name), end in zip(todo, ends) if end is not None]  # no values, no quantile
        if not todo:
            break
        counts = table.agg(*[
            F.struct(F.count(c), F.count_if(value[c] < F.lit(low)), F.count_if(value[c] <= F.lit(high))) for c, _, low, high in todo
        ]).first()
        missed = []
        for (c, name, low, high), (total, below, upto) in zip(todo, counts):
            at = probs[name] * (total - 1)
            if below <= math.floor(at) and math.ceil(at) < upto:
                bands.append(F.struct(
                    F.lit(c).alias("component"), F.lit(name).alias("prob"), value[c].alias("value"), F.lit(low).alias("low"),
                    F.lit(high).alias("high"), F.lit(below).cast("bigint").alias("below"), F.lit(at).cast("double").alias("at"),
                ))
            else:
                missed.append((c, name))
        todo, slack = missed, slack * 8
    return bands


def column_quantiles(table: DataFrame, columns: Sequence[str], probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Linearly interpolated quantiles of each column: ``component`` and one column per entry of ``probs``, nulls left out.

    No row is sorted or shuffled but those in the bands. ``table`` is read three times or so and should be stored; a column
    without values has no row.
    """
    bands = _bands(table, columns, probs, accuracy)
    if not bands:
        return table.sparkSession.createDataFrame([], ", ".join(["component string", *[f"`{n}` double" for n in probs]]))
    held = F.filter(F.array(*bands), lambda b: (b["value"] >= b["low"]) & (b["value"] <= b["high"]))
    inside = table.select(F.explode(held).alias("b")).select("b.*")
    counted = inside.groupBy("component", "prob", "below", "at", "value").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("component", "prob").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.col("below") + F.sum("_n").over(order))

    def pick(index: Column) -> Column:
        return F.max(F.when((F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index), F.col("value")))

    found = placed.groupBy("component", "prob", "at").agg(pick(F.floor("at")).alias("_lo"), pick(F.ceil("at")).alias("_hi"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("at") - F.floor("at"))
    return found.groupBy("component").agg(*[F.max(F.when(F.col("prob") == name, between)).alias(name) for name in probs])


# Hex digits of md5 that order a sample, and how many values they take.
HASH_DIGITS = 14
HASH_RANGE = 16**HASH_DIGITS


def seeded_hash(key: Column, seed: int) -> Column:
    """Repeatable uniform order of keys of any kind, the same in any SQL engine: leading digits of md5("seed:key")."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")


def take_by_hash(
    df: DataFrame, group_by: Sequence[str], key: str, seed: int, n: Column, bits: int = 12
) -> DataFrame:
    """The ``n`` rows of each group that come first in ``seeded_hash(key)`` order, ties by ``key``.

    ``n`` is an expression over columns of ``df`` that is constant in a group.
    Rows are counted by the leading hash bits (at most 2**bits counters per
    group); whole buckets before the cut are taken as they are, and only the
    single bucket holding the cut is ranked.
    """
    width = HASH_RANGE >> bits
    tagged = df.withColumns({"_hash": seeded_hash(F.col(key), seed), "_n": n}).withColumn(
        "_bucket", F.floor(F.col("_hash") / width)
    )
    upto = Window.partitionBy(*(group_by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = tagged.groupBy(*group_by, "_bucket").agg(F.count("*").alias("_in"))
    spans = counts.select(*group_by, "_bucket", (F.sum("_in").over(upto) - F.col("_in")).alias("_before"), "_in")
    marked = tagged.join(spans, [*group_by, "_bucket"]).where(F.col("_before") < F.col("_n"))
    whole = F.col("_before") + F.col("_in") <= F.col("_n")
    in_bucket = Window.partitionBy(*group_by, "_bucket").orderBy("_hash", key)
    cut = (
        marked.where(~whole)
        .withColumn("_place", F.row_number().over(in_bucket) + F.col("_before"))
        .where(F.col("_place") <= F.col("_n"))
    )
    return marked.where(whole).select(*df.columns).unionAll(cut.select(*df.columns))
