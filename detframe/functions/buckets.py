"""Buckets, names and list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bucket labels with their upper bounds (None = no bound).
DENSITY_BUCKETS = [("1", 1), ("2-4", 4), ("5-9", 9), ("10-14", 14), ("15-19", 19), ("20+", None)]
CROWDING_BUCKETS = [("0", 0), ("1-4", 4), ("5-19", 19), ("20+", None)]


def _bucket(n: Column, buckets) -> Column:
    chain = None
    for label, upper in buckets:
        if upper is None:
            return chain.otherwise(label)
        chain = F.when(n <= upper, label) if chain is None else chain.when(n <= upper, label)
    return chain


def density_bucket(n: Column) -> Column:
    return _bucket(n, DENSITY_BUCKETS)


def crowding_bucket(n: Column) -> Column:
    return _bucket(n, CROWDING_BUCKETS)


def bucket_table(spark: SparkSession, name: str, buckets) -> DataFrame:
    """Bucket dimension (at most six rows) with its display order."""
    rows = [(label, order) for order, (label, _) in enumerate(buckets)]
    return spark.createDataFrame(rows, f"{name} string, bucket_order int")


def clean_name(name: Column) -> Column:
    """Lower case, runs of other characters to one underscore, no outer underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_list(text: Column) -> Column:
    """List text to an array: JSON, then a list of quoted items (either quote, with the other inside), then the text as its only
    item; blank gives none."""
    as_json = F.from_json(text, "array<string>")
    is_list = F.trim(text).startswith("[")
    item = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    whole = F.trim(text).rlike(rf"^\[\s*(?:(?:{item})\s*,?\s*)+\]$")
    inner = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
    quoted = F.when(whole, F.transform(F.regexp_extract_all(text, F.lit(item), F.lit(0)), inner))
    swapped = F.coalesce(quoted, F.from_json(F.translate(text, "'", '"'), "array<string>"))
    empty = F.array().cast("array<string>")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), empty)
        .when(is_list & as_json.isNotNull(), as_json)
        .when(is_list & swapped.isNotNull(), swapped)
        .otherwise(F.array(text))
    )
