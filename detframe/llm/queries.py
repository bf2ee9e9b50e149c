"""One query for each operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.llm import binfit, divergence, idfiles, jaccard, licences, lines, lm, oracles, packing, pieces, quality, topk, toxicity, turns
from detframe.llm.common import table
from detframe.llm.registry import query

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read_ids(idfiles.write_ids(table(spark, sf_dir, "documents"), BYTE_BPE))


@query("op4_licences")
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    first = F.transform("places", lambda p: p["first"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.transform(F.filter("spans", lambda s: s["covered"] >= licences.MIN_COVER), lambda s: s["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(best, F.lit(1.0))).alias("score"),
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("removed").cast("long").alias("runs_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["lines"]).alias("lines_removed"),
        F.transform("removed", lambda x: x["first"]).alias("first_lines"),
        F.length("text").cast("long").alias("chars_left"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = jaccard.links(docs.select(F.col("doc_id").alias("row"), "doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "copies")


@query(
    "op10_topk",
    "with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings "
    "where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), "
    "s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score "
    "from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0), "
    "r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) "
    "select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 5",
)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op3_piece_dropout")
def op3_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


@query("op11_source_divergence", oracles.DIVERGENCE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_turn_repair", oracles.TURN_REPAIR)
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns_given = table(spark, sf_dir, "conversations")
    return turns.digest(turns_given, turns.damage(turns_given))


@query("op13_best_fit")
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binfit.pack(table(spark, sf_dir, "documents"), WORD_BPE)
