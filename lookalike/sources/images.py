"""Image files and their metadata as DataFrames."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.hashers import image_hash

#: Matched while files are listed, so others are never opened.
GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[bB][mM][pP]}"
#: What a file that can't be read counts as.
MISSING = {"pixels": -1, "size": -1, "mtime": (1 << 63) - 1}


def local_path(uri: Column) -> Column:
    """Path text of a file URI."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"\+", "%2B"), "^file:/+", "/"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of the image files under ``root``; contents aren't read. File sources leave out
    names that begin with a dot or an underscore: see ``hidden``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(root)
    return found.select(local_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")).where(scalars.is_image(F.col("path")))


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, image) of the image files that can be decoded, whatever their extension says."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).option("dropInvalid", "true").load(root)
    return found.select(local_path(F.col("image.origin")).alias("path"), "image")


def hashed(spark: SparkSession, root: str, algorithm: str = "phash", orientation: int | None = None) -> DataFrame:
    """(path, hash, pixels) of the images under ``root``; those that can't be hashed are left out."""
    return _hashed(images(spark, root), algorithm, orientation)


def hashed_files(spark: SparkSession, paths: list[str], algorithm: str = "phash") -> DataFrame:
    """(path, hash, pixels) of the images among some files, which alone are read."""
    exact = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    found = spark.read.format("image").option("dropInvalid", "true").load(exact)
    return _hashed(found.select(local_path(F.col("image.origin")).alias("path"), "image"), algorithm, None)


def _hashed(found: DataFrame, algorithm: str, orientation: int | None) -> DataFrame:
    rows = found.select("path", image_hash(algorithm, orientation)("image").alias("hash"), (F.col("image.width").cast("long") * F.col("image.height")).alias("pixels"))
    return rows.where("hash is not null")


def skipped(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """(path, size, mtime) of the image files under ``root`` that an index lacks, as they couldn't be read."""
    return files(spark, root).join(index.select("path"), "path", "left_anti")


def file_facts(spark: SparkSession, root: str) -> DataFrame:
    """(path, pixels, size, mtime) of the image files under ``root``; pixels are -1 where a file can't be
    decoded."""
    pixels = images(spark, root).select("path", (F.col("image.width").cast("long") * F.col("image.height")).alias("pixels"))
    return files(spark, root).join(pixels, "path", "left").select("path", F.coalesce("pixels", F.lit(-1).cast("long")).alias("pixels"), "size", "mtime")


def listing_facts(paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, size, mtime) of files on the driver's disk; those that don't exist are left out."""
    out = []
    for path in paths:
        if os.path.exists(path):
            info = os.stat(path)
            out.append((path, info.st_size, info.st_mtime_ns // 1_000_000))
    return out


def hidden(root: str) -> list[str]:
    """Image files on the driver's disk that file sources leave out for a dot or underscore in front of
    their name or of a folder's."""
    base = Path(root)
    return sorted(str(p) for p in base.rglob("*") if p.is_file() and re.match(scalars.IMAGE_NAME.replace("(?i)", ""), str(p), re.I) and any(x[0] in "._" for x in p.relative_to(base).parts))


def stage_hidden(root: str) -> tuple[str, dict[str, str]]:
    """Links to the hidden files in a fresh folder under visible names, and each link's original: a way
    to read them all the same."""
    target, names = tempfile.mkdtemp(prefix="visible"), {}
    for k, path in enumerate(hidden(root)):
        link = os.path.join(target, f"{k}-{os.path.basename(path).lstrip('._') or 'image'}")
        os.symlink(path, link)
        names[link] = path
    return target, names


def image_bytes(spark: SparkSession, path: str, allowed: DataFrame) -> tuple[bytes, str] | None:
    """Content and media type of one image that ``allowed`` (a table with a path column) lists; None for
    any other path."""
    if not allowed.where(F.col("path") == path).limit(1).count():
        return None
    row = spark.read.format("binaryFile").load(path).select("content", scalars.media_type(F.col("path")).alias("kind")).first()
    return (bytes(row["content"]), row["kind"]) if row else None
