"""Reading and writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.session import path_exists


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stored table with its declared schema; ``csv`` has a header and JSON text in list columns."""
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    fields = spark.createDataFrame([], schema).schema.fields
    flat = ", ".join(f"`{f.name}` {'string' if f.dataType.typeName() == 'array' else f.dataType.simpleString()}" for f in fields)
    rows = spark.read.schema(flat).option("header", True).option("escape", '"').csv(path)
    return rows.select(
        *[
            F.from_json(f.name, f.dataType.simpleString()).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in fields
        ]
    )


def lists_to_json(df: DataFrame) -> DataFrame:
    """List columns as JSON text, for formats without lists."""
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({n: F.to_json(n) for n in lists}) if lists else df


def write_table(
    df: DataFrame, path: str, run_label: str, force: bool = False, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write under ``path/run_label=<label>`` unless it is there already; ``force`` rewrites it. Returns a scan of it.

    A table is there when its write was committed, which Spark marks last; what an interrupted run left is replaced.
    """
    target = f"{path}/run_label={run_label}"
    out = lists_to_json(df) if fmt == "csv" else df
    writer = out.write.mode("overwrite").partitionBy(*partition_by)
    missing = force or not path_exists(df.sparkSession, f"{target}/_SUCCESS")
    if fmt == "csv":
        if missing:
            writer.option("header", True).option("escape", '"').csv(target)
        return df.sparkSession.read.option("header", True).option("escape", '"').schema(out.schema).csv(target)
    if missing:
        writer.format(fmt).save(target)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(target)


def sample_label(first: int | None = None, sample: int | None = None) -> str:
    """Run label of a full run, the first n images, or a sample of n."""
    if first is not None:
        return f"first_{first}"
    return f"sample{sample}" if sample is not None else "full"
