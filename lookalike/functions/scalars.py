"""Scalar functions over hashes, paths, actions and file facts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image files by extension, whatever the case.
IMAGE_NAME = r"(?i)^.*\.(jpg|jpeg|png|bmp)$"
#: Media type by file extension.
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp"}
OTHER_TYPE = "application/octet-stream"
ACTIONS = ("keep", "delete")


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two patterns differ."""
    return F.bit_count(a.bitwiseXOR(b))


def radius_of(threshold: Column) -> Column:
    """Largest Hamming distance of a similarity threshold; halves round up."""
    return F.floor((F.lit(1e0) - threshold.cast("double")) * F.lit(64e0) + F.lit(0.5e0)).cast("int")


def is_image(path: Column) -> Column:
    return path.rlike(IMAGE_NAME)


def media_type(path: Column) -> Column:
    low, out = F.lower(path), None
    for ending, kind in MEDIA_TYPES.items():
        out = F.when(low.endswith(ending), kind) if out is None else out.when(low.endswith(ending), kind)
    return out.otherwise(OTHER_TYPE)


def normal_action(action: Column) -> Column:
    """keep or delete; anything else, null too, is keep."""
    low = F.lower(F.trim(action))
    return F.when(low.isin(*ACTIONS), low).otherwise("keep")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(name: Column) -> Column:
    """Name without its extension; a dot in front starts none."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)(\.[^.]*)$", 1)).otherwise(name)


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.+)(\.[^.]*)$", 2)


def tidy_path(path: Column) -> Column:
    """Runs of slashes become one, and a slash at the end goes."""
    one = F.regexp_replace(path, "/+", "/")
    return F.when(one == "/", one).otherwise(F.regexp_replace(one, "/$", ""))


def size_label(size: Column) -> Column:
    """Megabytes with two decimals, or whole kilobytes where those would be 0.00."""
    mb = F.round(size.cast("double") / F.lit(1048576e0), 2)
    return F.when(mb == 0, F.format_string("%d KB", F.round(size.cast("double") / F.lit(1024e0), 0).cast("long"))).otherwise(F.format_string("%.2f MB", mb))


def day_label(millis: Column) -> Column:
    """Date of epoch milliseconds, in the session's time zone."""
    return F.when(millis > 0, F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")).otherwise("")


def url_component(text: Column) -> Column:
    """Percent-encoding for one part of a URL."""
    return F.regexp_replace(F.url_encode(text), r"\+", "%20")


def reason(kind: Column | str, pixels: Column, size: Column, mtime: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.format_string("%s(pixels=%d,size=%d,mtime=%d)", kind, pixels, size, mtime)
