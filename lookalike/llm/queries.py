"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_text, mixing, ngram_join, pieces, quality, quoting, repeats, token_counts, toxicity
from .common import table
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takings(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes: the turn it answers or -1, its path, and the digest of its text."""
    rows = quoting.unquoted(table(spark, sf_dir, "conversations"))
    path = F.concat_ws("/", F.transform("path", lambda x: x.cast("string")))
    return rows.select("conv_id", "turn", "role", F.coalesce("parent_turn", F.lit(-1)).cast("long").alias("parent_turn"), path.alias("reply_path"), "n_quoted", F.sha2("text", 256).alias("text_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest (of the ids, joined by commas) of every document's pieces, and whether decoding
    gives back its text."""
    rows = pieces.encode(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "exact")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_html_text, op4_mixing, op5_quality, op6_quoting, op7_nearest, op8_pieces, op9_ngram_join, op10_repeats)}
