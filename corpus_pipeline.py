"""Corpus preparation in five stages, each written as Parquet and read again as the documents of the next.

Every stage gets all rows its predecessor kept, and returns the columns of ``documents`` (the last: pieces of packed sequences).
``ORACLE_SQL`` is None because no stage can be written in SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.llm import jaccard, lines, packing, quality, toxicity
from detframe.llm.common import stored, table, visible

ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the rules or the likelihood ratio go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents predicted toxic go."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of line runs go, and documents that lose their whole text; ``n_chars`` follows the text."""
    found = lines.dedup(docs)
    if "n_chars" in docs.columns:
        changed = F.size(found.columns[-1]) > 0
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return lines.drop_emptied(found)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the first document of each class of near copies stays."""
    return jaccard.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: all that is left, laid end to end and cut."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("line_dedup", lines_once),
    ("near_duplicates", one_of_each_class),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
