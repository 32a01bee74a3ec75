"""The stages as calls on files: hash, cluster, plan, apply; and all of them at once as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashers import find
from .operators import clusters as cl
from .operators import plan as pl
from .operators import quarantine
from .plans.stage_table import cut, exists
from .sources import images, interchange


class EmptyResult(Exception):
    """A stage found nothing that it could work on."""


def session() -> SparkSession:
    return SparkSession.builder.appName("lookalike").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def radius_of(threshold: float) -> int:
    """Hamming radius of a similarity threshold, halves rounded up."""
    import math

    return math.floor((1 - threshold) * 64 + 0.5)


def hash_images(spark: SparkSession, root: str, out: str, algorithm: str = "phash") -> int:
    """Write the index of the images under ``root``; returns how many were hashed."""
    find(algorithm)
    if not exists(spark, root):
        raise FileNotFoundError(root)
    index = cut(images.hashed(spark, root, algorithm).select("path", "hash"))
    interchange.write_index(index, out)
    return index.count()


def cluster_images(spark: SparkSession, index: str, out: str, radius: int = 10, threshold: float | None = None) -> dict:
    """Write the clusters with duplicates of an index; returns the counts of all clusters. A threshold of
    similarity takes the place of the radius."""
    radius = radius if threshold is None else radius_of(threshold)
    if not exists(spark, index):
        raise FileNotFoundError(index)
    found = cut(cl.cluster(interchange.read_index(spark, index), radius))
    interchange.write_clusters(cl.duplicates(found), out)
    return cl.summary(found).first().asDict()


def generate_plan(spark: SparkSession, clusters: str, out: str, root: str | None = None) -> dict:
    """Write the plan of a clusters file; file facts come from ``root``, else from each path's folder."""
    rows = interchange.read_clusters(spark, clusters)
    roots = [root] if root else [r[0] for r in rows.selectExpr("regexp_replace(path, '/[^/]*$', '') AS folder").distinct().collect()]
    facts = None
    for folder in roots:
        if exists(spark, folder):
            own = images.file_facts(spark, folder)
            facts = own if facts is None else facts.union(own)
    if facts is None:
        facts = spark.createDataFrame([], "path string, pixels long, size long, mtime long")
    plan = cut(pl.make_plan(rows, facts.dropDuplicates(["path"])))
    interchange.write_plan(plan, out)
    return pl.stats(plan).first().asDict()


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan file, quoted or, if its first row has no quotation mark, in the older form without."""
    value = F.trim("value")
    row = spark.read.text(path).where((value != "") & ~F.ltrim(F.regexp_replace("value", '"', "")).startswith("clusterId,action,path")).first()
    plain = row is not None and '"' not in row["value"]
    rows = pl.normalise(interchange.read_plain_plan(spark, path)) if plain else interchange.read_plan(spark, path)
    return rows.withColumnRenamed("clusterId", "cluster_id")


def apply_plan(spark: SparkSession, path: str, folder: str = "./quarantine", **options) -> Iterator[dict]:
    return quarantine.apply_plan(read_plan(spark, path), folder, **options)


def find_duplicates(spark: SparkSession, root: str, algorithm: str = "phash", radius: int = 10) -> DataFrame:
    """The plan for the images under ``root``, without files between stages."""
    index = cut(images.hashed(spark, root, algorithm))
    groups = cl.duplicates(cl.cluster(index.select("path", "hash"), radius))
    facts = images.files(spark, root).join(index.select("path", "pixels"), "path", "left").select("path", "pixels", "size", "mtime")
    return pl.make_plan(groups, facts)
