"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job in this package is written for."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.filterPushdown", "true")
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets one temporary folder; a cluster
    session without it is refused, because executors could not share it.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-detframe-", dir="/tmp")
    spark.conf.set(SETTING, folder)
    return folder


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage: the result is read from storage, so it survives lost
    executors, gives the same rows to every reader, and keeps column pruning
    and filter pushdown. With ``by``, rows are bucketed by that column, so
    joins and groups on it shuffle nothing.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/detframe/{app}/{name}"
    if by is not None:
        return bucketed(df, name.replace("-", "_"), path, by)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, table: str, path: str, by: str) -> DataFrame:
    """``df`` as a table at ``path`` with a bucket of ``by`` for each shuffle partition, one file each."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, by)
    dealt.write.format("parquet").mode("overwrite").option("path", path).bucketBy(parts, by).saveAsTable(table)
    return spark.table(table)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
