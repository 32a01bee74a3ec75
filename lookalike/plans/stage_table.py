"""Cutting a plan at a table written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_written: list = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a local folder if all tasks run on this machine,
    and an error if not, as no other machine could read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store its scheme names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back. Lineage ends at files that outlive any executor; they are removed
    when Python exits."""
    path = scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table of cut() that nothing reads any more."""
    files = df.inputFiles()
    for found in [x for x in _written if files and f"/{x[1].rpartition('/')[2]}/" in files[0]]:
        remove(*found)
        _written.remove(found)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before Python
            if path.startswith("file:"):
                shutil.rmtree(urlsplit(path).path, ignore_errors=True)
