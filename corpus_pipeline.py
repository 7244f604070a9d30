"""A training-data pipeline of five of the corpus operators over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlake.llm.bpe import encode_decode
from plainlake.llm.language import UNKNOWN, fit, held_out, identify, vocabulary
from plainlake.llm.line_dedup import dedup_lines
from plainlake.llm.mixing import apply_rates, mix
from plainlake.llm.near_dedup import near_duplicates
from plainlake.llm.queries import tokenizer_path
from plainlake.llm.shared import Workspace, free_names, read
from plainlake.session import let_go

#: A document whose best language is less likely than this is rejected, as is one without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows teach. A null text or one without a letter goes, and with
    nothing learned every text does; an empty table gives an empty table."""
    let_go(spark)
    model = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()), vocabulary(tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    out = identify(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; n_chars follows the text, and null text becomes empty. An empty table
    gives an empty table."""
    let_go(spark)
    out = dedup_lines(docs, Workspace(spark, "pipeline-lines"), out="kept_text")
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of least doc_id (null last). Rows are searched by a key of their
    own, so two texts of one doc_id are two documents, and rows without a doc_id take part; equal rows are one. Rows
    without a word are near to nothing but equal rows. An empty table gives an empty table."""
    let_go(spark)
    (key,) = free_names(docs, 1)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), Workspace(spark, "pipeline-near")).select(F.col("doc_id").alias(key), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")
    kept = keyed.select(key, "doc_id").distinct().join(found, key).groupBy("component_id").agg(first).select(F.col(f"first.{key}").alias(key))
    return keyed.join(kept.hint("shuffle_hash"), key, "left_semi").dropDuplicates([key]).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say; null and empty texts once. An empty table gives an empty table."""
    let_go(spark)
    return apply_rates(docs, mix(docs, read(spark, sf_dir, "labels"), Workspace(spark, "pipeline-mixing")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text; null text has none. An empty table gives an
    empty table."""
    let_go(spark)
    out = encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near), ("mixing", mixing), ("BPE", encoding)]

#: Neither trained classifiers nor BPE merges can be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.save(docs, f"stage-{k}")
    return docs
