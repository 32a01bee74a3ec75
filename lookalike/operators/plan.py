"""Keep/delete plans: ranking inside clusters, reviewing, and joining plans with files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.images import MISSING


def with_facts(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """Clusters with the pixels, size and mtime of each path; what is missing ranks last."""
    known = clusters.join(facts, "path", "left")
    return known.select("cluster_id", "path", *[F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in MISSING.items()])


def ranked(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """Clusters with file facts and each row's rank: more pixels, then more bytes, then older, then by name
    whatever the case. A cluster is ordered in one task; plans, which need the best alone, don't use this."""
    order = W.partitionBy("cluster_id").orderBy(F.desc("pixels"), F.desc("size"), F.asc("mtime"), F.lower("path"), F.col("path"))
    return with_facts(clusters, facts).withColumn("rank", F.row_number().over(order))


def _is_first(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``first``: whether a row is its cluster's first by ``order`` and path. The least key of a cluster
    is an aggregate, so no task orders a whole cluster."""
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.col("path"))
    least = rows.groupBy("cluster_id").agg(F.min(key)["path"].alias("_least"))
    return rows.join(least, "cluster_id").withColumn("first", F.col("path") == F.col("_least")).drop("_least")


def make_plan(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """(cluster_id, action, path, reason, pixels, size, mtime): the best of each cluster is kept, the rest
    deleted."""
    rows = _is_first(with_facts(clusters, facts), -F.col("pixels"), -F.col("size"), F.col("mtime"), F.lower("path"))
    kind = F.when(F.col("first"), "keeper").otherwise("dupe")
    reason = scalars.reason(kind, F.col("pixels"), F.col("size"), F.col("mtime"))
    return rows.select("cluster_id", F.when(F.col("first"), "KEEP").otherwise("DELETE").alias("action"), "path", reason.alias("reason"), "pixels", "size", "mtime")


def stats(plan: DataFrame) -> DataFrame:
    """One row: clusters, rows, rows kept, rows deleted."""
    action = F.lower("action")
    return plan.agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_rows"), F.count_if(action == "keep").alias("n_keep"), F.count_if(action == "delete").alias("n_delete"))


def normalise(plan: DataFrame) -> DataFrame:
    return plan.withColumn("action", scalars.normal_action(F.col("action")))


def set_all(plan: DataFrame, action: str, cluster_id=None) -> DataFrame:
    """Every row of a cluster, or of all, gets one action."""
    hit = F.lit(True) if cluster_id is None else F.col("cluster_id") == cluster_id
    return plan.withColumns({"action": F.when(hit, action).otherwise(F.col("action")), "reason": F.when(hit, f"Set all to {action}").otherwise(F.col("reason"))})


def set_one(plan: DataFrame, cluster_id, path: str, action: str) -> DataFrame:
    hit = (F.col("cluster_id") == cluster_id) & (F.col("path") == path)
    return plan.withColumns({"action": F.when(hit, action).otherwise(F.col("action")), "reason": F.when(hit, "Manual selection").otherwise(F.col("reason"))})


def toggle(plan: DataFrame, cluster_id, path: str) -> DataFrame:
    """The other action for one row."""
    hit = (F.col("cluster_id") == cluster_id) & (F.col("path") == path)
    other = F.when(F.lower("action") == "keep", "delete").otherwise("keep")
    return plan.withColumns({"action": F.when(hit, other).otherwise(F.col("action")), "reason": F.when(hit, "Manual selection").otherwise(F.col("reason"))})


def _order(files: DataFrame) -> list[Column]:
    return [F.col("ord")] if "ord" in files.columns else []


def auto_select(files: DataFrame) -> DataFrame:
    """(cluster_id, path, action, reason) by size alone: the largest file of each cluster is kept, the
    first of equals; the order is ``ord`` where it is a column, else that of paths."""
    rows = _is_first(files, -F.coalesce("size", F.lit(0)), *_order(files))
    return rows.select("cluster_id", "path", F.when(F.col("first"), "keep").otherwise("delete").alias("action"), F.when(F.col("first"), "Largest file kept").otherwise("Smaller duplicate removed").alias("reason"))


def badges(files: DataFrame) -> DataFrame:
    """(cluster_id, path, is_largest, is_oldest): the first file of the greatest size above 0, and the
    first of the least mtime, where 0 and null are no mtime."""
    rows = _is_first(files, -F.coalesce("size", F.lit(0)), *_order(files)).withColumnRenamed("first", "_largest")
    rows = _is_first(rows, F.coalesce(F.nullif("mtime", F.lit(0)), F.lit(MISSING["mtime"])), *_order(files))
    largest = F.col("_largest") & (F.coalesce("size", F.lit(0)) > 0)
    oldest = F.col("first") & (F.coalesce("mtime", F.lit(0)) != 0)
    return rows.select("cluster_id", "path", largest.alias("is_largest"), oldest.alias("is_oldest"))


def listing(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, files) with {path, size, modified} of each cluster's files, for showing clusters that fit a row;
    files unknown to ``facts`` have 0."""
    rows = clusters.join(facts, "path", "left")
    file = F.struct("path", F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("mtime", F.lit(0).cast("long")).alias("modified"))
    return rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list(file)).alias("files")).select(F.col("cluster_id").alias("id"), "files")


def keepers(plan: DataFrame) -> DataFrame:
    """(cluster_id, keeper): the kept path of each cluster, the last by ``ord``, else by path."""
    order = "ord" if "ord" in plan.columns else "path"
    return plan.where(F.upper("action") == "KEEP").groupBy("cluster_id").agg(F.max_by("path", order).alias("keeper"))


def with_keepers(plan: DataFrame) -> DataFrame:
    """The rows to delete with their cluster's keeper, null where it has none."""
    return plan.where(F.upper("action") == "DELETE").join(keepers(plan), "cluster_id", "left")


def without_keeper(plan: DataFrame) -> DataFrame:
    """cluster_id of the clusters that a plan would delete whole."""
    return plan.groupBy("cluster_id").agg(F.count_if(F.upper("action") == "KEEP").alias("n")).where("n = 0").select("cluster_id")


def reviewed(clusters: DataFrame, plan: DataFrame) -> DataFrame:
    """(cluster_id, path, action) of all cluster rows; rows the plan doesn't name are kept."""
    marks = plan.groupBy("cluster_id", "path").agg(F.max("action").alias("action"))
    return clusters.select("cluster_id", "path").join(marks, ["cluster_id", "path"], "left").select("cluster_id", "path", scalars.normal_action(F.col("action")).alias("action"))


def or_auto(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan, or the selection by size where it has no rows."""
    return plan.select("cluster_id", "path", "action", "reason") if plan.limit(1).count() else auto_select(files)
