"""Helpers shared by the text operators: stored tables, Arrow batches as byte texts, ordered shards."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.session import work_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder of the session (``spark.checkpoint.dir``)."""
    return f"{work_dir(spark)}/detframe-llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is read twice is computed once and survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by its name; the first, where a table repeats the name."""
    return batch.column(batch.schema.names.index(name))


def rows(schema: pa.Schema, **values: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in schema], schema=schema)


def fold(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo ``folds``; a null id has no digits."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(name: str, folds: int):
    """``fold`` as a column expression."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % folds


def filtered(docs: DataFrame, keeps) -> DataFrame:
    """The rows of ``docs`` for which ``keeps(texts)`` gives True, all columns as they are; no shuffle."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keeps(byte_texts(batch.column(place))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Ids up to which ``pick`` sends them to every task (16 bytes each, so 32 MB); beyond it both sides are shuffled.
SENT_IDS = 2_000_000


def pick(docs: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and ``text`` of the documents whose id is in ``ids``, with further columns of ``ids`` (one row per id)."""
    wanted = ids.select("doc_id", *columns).filter("doc_id is not null").dropDuplicates(["doc_id"])
    small = wanted.count() <= SENT_IDS
    return docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, "doc_id")


def visible(spark: SparkSession) -> None:
    """Lets Python workers import this package where the session was started from elsewhere; on a cluster, ship the package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
