"""Hashing images as they arrive, and keeping the components of all that has arrived.

Each micro-batch reads and hashes its own files, at most MAX_FILES, and appends them to the index table; only
distinct hashes that are new are joined with the index, by bands, so the work on images is that of the batch, and
the join reads the index's hashes once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import is_image
from ..operators.components import components
from ..operators.similarity import pairs_between
from ..sources.images import GLOB, hashed_files, local_path

#: Files of a micro-batch, at most; their names reach the driver.
MAX_FILES = 1000
INDEX, LINKS = "path string, hash long", "a long, b long"


def arrivals(spark: SparkSession, root: str, max_files: int = MAX_FILES) -> DataFrame:
    """A stream of the paths of new image files."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", max_files).load(root)
    return found.select("path", "modificationTime", "length").where(is_image(F.col("path")))


def add_batch(index: DataFrame, links: DataFrame, new: DataFrame, radius: int) -> DataFrame:
    """The links (a, b) that new items (path, hash) add to those of an index."""
    known = index.select("hash").union(new.select("hash"))
    found = pairs_between(new, known, radius).where("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(links, ["a", "b"], "left_anti")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches so far, with their batch; none where no batch has been written."""
    try:
        return spark.read.schema(f"{schema}, batch int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch int")


def watch(spark: SparkSession, root: str, index_path: str, links_path: str, checkpoint: str, algorithm: str = "phash", radius: int = 3) -> StreamingQuery:
    """Start the query; index and links are Parquet folders with a folder for each batch. A batch that is
    run again after a failure replaces its own rows."""

    def batch(paths: DataFrame, number: int) -> None:
        own = [r["path"] for r in paths.select(local_path(F.col("path")).alias("path")).collect()]
        if not own:
            return
        hashed_files(spark, own, algorithm).select("path", "hash").write.mode("overwrite").parquet(f"{index_path}/batch={number}")
        index = _read(spark, index_path, INDEX)
        links = _read(spark, links_path, LINKS).where(F.col("batch") < number).select("a", "b")
        more = add_batch(index.where(F.col("batch") < number), links, index.where(F.col("batch") == number), radius)
        more.write.mode("overwrite").parquet(f"{links_path}/batch={number}")

    return arrivals(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_clusters(spark: SparkSession, index_path: str, links_path: str) -> DataFrame:
    """(cluster, path) of all items so far; cluster is the smallest hash of the component."""
    items = _read(spark, index_path, INDEX).select("path", "hash")
    label = components(_read(spark, links_path, LINKS).select("a", "b")).withColumnsRenamed({"node": "hash"})
    return items.join(label, "hash", "left").select(F.coalesce("component", "hash").alias("cluster"), "path")
