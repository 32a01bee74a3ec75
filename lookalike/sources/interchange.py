"""Interchange files between stages: indexes, clusters and plans as text, and JSON forms of them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.u64 import format_u64, parse_u64

PLAN_COLUMNS = ("clusterId", "action", "path", "reason")
PLAN_SCHEMA = "clusterId string, action string, path string, reason string"
PLAN_JSON = f"array<struct<{', '.join(f'{c}: string' for c in PLAN_COLUMNS)}>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


# -- readers -----------------------------------------------------------------------------------


def read_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, hash) of lines ``path,number``; the path may hold commas. A path that occurs again keeps
    its last hash. A bad number is an error, or a dropped line where ``strict`` is false."""
    text = F.col("value")
    rows = _lines(spark, path).select("_metadata.file_path", F.monotonically_increasing_id().alias("ord"), F.regexp_extract(text, "^(.+),([^,]*)$", 1).alias("path"), F.trim(F.regexp_extract(text, "^(.+),([^,]*)$", 2)).alias("number")).where("path <> ''")
    rows = rows.withColumn("hash", parse_u64(F.col("number"), strict)).where("hash is not null")
    return rows.groupBy("path").agg(F.max_by("hash", "ord").alias("hash"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, path) of lines ``id,path``, split at the first comma; lines without one are skipped."""
    at = F.instr("value", ",")
    return _lines(spark, path).where(at > 1).select(F.substring_index("value", ",", 1).alias("cluster_id"), F.expr("substring(value, instr(value, ',') + 1)").alias("path"))


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan rows of a quoted CSV file with a header; a missing reason is empty, actions are normalised."""
    rows = spark.read.csv(path, header=True, schema=PLAN_SCHEMA, mode="PERMISSIVE", escape='"', multiLine=True)
    return rows.withColumns({"reason": F.coalesce("reason", F.lit("")), "action": scalars.normal_action(F.col("action"))})


def read_plain_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan rows of an older, unquoted file: three commas split a line, and the rest is the reason."""
    parts = F.split("value", ",", 4)
    rows = _lines(spark, path).where(~F.col("value").startswith("clusterId,action,path"))
    return rows.select(parts.alias("p")).where(F.size("p") >= 3).select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(PLAN_COLUMNS)])


def plan_from_json(body: Column) -> Column:
    """A JSON list of plan rows as an array of structs."""
    return F.from_json(body, PLAN_JSON)


# -- writers -----------------------------------------------------------------------------------


def in_own_folder(path: str) -> str:
    """A bare file name goes into a fresh dot folder of the working directory."""
    return path if os.path.dirname(path) else os.path.join(tempfile.mkdtemp(prefix=".dup", dir="."), path)


def index_lines(index: DataFrame) -> DataFrame:
    return index.select(F.concat_ws(",", "path", format_u64(F.col("hash"))).alias("value"))


def write_index(index: DataFrame, path: str) -> None:
    """``path,number`` lines, without a header, as a folder of text files."""
    index_lines(index).write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """``id,path`` lines of the clusters with more than one member."""
    clusters.select(F.concat_ws(",", "cluster_id", "path").alias("value")).write.mode("overwrite").text(path)


def write_plan(plan: DataFrame, path: str) -> None:
    """Plan rows as quoted CSV with a header."""
    plan.select(F.col("cluster_id").cast("string").alias("clusterId"), "action", "path", "reason").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def plan_json(plan: DataFrame) -> DataFrame:
    """One JSON object in ``json`` for each plan row."""
    return plan.select(F.to_json(F.struct(F.col("cluster_id").cast("string").alias("clusterId"), "action", "path", "reason")).alias("json"))
