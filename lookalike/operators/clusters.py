"""Single-linkage clusters of items whose hashes lie within a radius."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .similarity import hash_pairs


def cluster(items: DataFrame, radius: int = 10, strategy: str = "auto") -> DataFrame:
    """(cluster_id, path, hash) of every item; an item near no other is a cluster of its own. The id of a
    cluster is its smallest path. Links are found between distinct hashes; a negative radius makes only
    single items, one of 64 or more a single cluster."""
    if not 0 <= radius <= 64:
        warnings.warn(f"radius {radius} is outside 0..64", stacklevel=2)
    if radius < 0:
        return items.select(F.col("path").alias("cluster_id"), "path", "hash")
    if radius >= 64:
        return items.select(items.agg(F.min("path")).scalar().alias("cluster_id"), "path", "hash")
    links = hash_pairs(items, radius, strategy).select("a", "b")
    label = components(links).withColumnsRenamed({"node": "hash"})
    by_hash = items.groupBy("hash").agg(F.min("path").alias("least")).join(label, "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    named = by_hash.groupBy("component").agg(F.min("least").alias("cluster_id")).join(by_hash.select("hash", "component"), "component")
    return items.join(named.select("hash", "cluster_id"), "hash").select("cluster_id", "path", "hash")


def duplicates(clusters: DataFrame) -> DataFrame:
    """The rows of clusters with more than one member."""
    return clusters.join(sizes(clusters).where("n > 1"), "cluster_id", "left_semi")


def sizes(clusters: DataFrame) -> DataFrame:
    """(cluster_id, n) of each cluster."""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))


def summary(clusters: DataFrame) -> DataFrame:
    """One row: clusters, clusters with duplicates, and items."""
    return sizes(clusters).agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_duplicate_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))


def members(clusters: DataFrame) -> DataFrame:
    """(cluster_id, members) with the paths in order, for showing clusters that fit a row."""
    return clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_list("path")).alias("members"))
