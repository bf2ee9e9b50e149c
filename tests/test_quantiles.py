"""Quantiles of many columns from bands, against plain interpolation."""

import math
import random

import pytest

from detframe.operators.loss import COMPONENTS, COUNTS, component_scales, describe_components
from detframe.operators.ranking import column_quantiles

PROBS = {"low": 0.0, "q25": 0.25, "q50": 0.5, "p95": 0.95, "top": 1.0}


def plain(values, p):
    values = sorted(v for v in values if v is not None)
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_of_columns(spark, accuracy):
    """Heavy tails, one value that fills most rows, few values, nulls, a column without values."""
    rng = random.Random(11)
    rows = [
        (rng.paretovariate(0.3), rng.choice([0.0, 0.0, 0.0, 0.0, rng.random()]), rng.randrange(3), rng.choice([None, rng.gauss(0, 1)]), None)
        for _ in range(3_001)
    ]
    names = ["tail", "hot", "few", "gaps", "none"]
    table = spark.createDataFrame(rows, "tail double, hot double, few int, gaps double, none double").repartition(5)
    got = {r.component: r for r in column_quantiles(table, names, PROBS, accuracy).collect()}
    assert set(got) == set(names[:4])
    for k, name in enumerate(names[:4]):
        for prob, p in PROBS.items():
            assert got[name][prob] == pytest.approx(plain([r[k] for r in rows], p), rel=1e-12), (name, prob)


def test_no_values_and_one_value(spark):
    table = spark.createDataFrame([(1.5, None)], "a double, b double")
    assert [tuple(r) for r in column_quantiles(table, ["a", "b"], {"q": 0.3}).collect()] == [("a", 1.5)]
    assert column_quantiles(table.limit(0), ["a"], {"q": 0.3}).collect() == []


def test_summaries_sort_no_rows_over_ranges(spark, capsys):
    names = [*COMPONENTS, *COUNTS]
    table = spark.range(500).selectExpr("id image_id", *[f"cast(id % {k + 3} as {'double' if k < 4 else 'bigint'}) {n}" for k, n in enumerate(names)])
    for out in (describe_components(table), component_scales(table)):
        out.explain()
        assert "rangepartitioning" not in capsys.readouterr().out
