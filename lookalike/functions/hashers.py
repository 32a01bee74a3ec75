"""Perceptual hashes of 64 bits: over image rasters as Arrow UDFs, over 8 x 8 array columns as expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import raster

#: Coefficients nearer to zero than this count as zero, and bits need more than this above the mean.
TINY = 1e-9


def pack(bits: np.ndarray) -> int:
    """64 flags as a signed pattern, the first flag being the lowest bit."""
    return int(np.packbits(bits.reshape(64), bitorder="little").view("<i8")[0])


def ahash(gray: np.ndarray) -> int:
    """Bits of the 8 x 8 levels that are at or above their mean."""
    levels = raster.luma_levels()[0][raster.resize(gray, 8, 8)]
    return pack(levels >= levels.mean())


def dhash(gray: np.ndarray) -> int:
    """Bits of the 9 x 8 levels that are above their right neighbour."""
    levels = raster.luma_levels()[0][raster.resize(gray, 9, 8)]
    return pack(levels[:, :-1] > levels[:, 1:])


@functools.cache
def cosine_basis(size: int = 32, keep: int = 8) -> np.ndarray:
    """The first rows of the orthonormal DCT-II matrix."""
    u, x = np.arange(keep)[:, None], np.arange(size)[None]
    scale = np.where(u == 0, np.sqrt(1 / size), np.sqrt(2 / size))
    return scale * np.cos((2 * x + 1) * u * np.pi / (2 * size))


def phash(gray: np.ndarray) -> int:
    """Bits of the lowest 8 x 8 cosine coefficients that are above the mean of the nonzero ones, the
    constant term apart."""
    c = cosine_basis()
    low = (c @ raster.luma_levels()[1][raster.resize(gray, 32, 32)] @ c.T).reshape(64)
    low[np.abs(low) < TINY] = 0.0
    rest = low[1:][low[1:] != 0]
    return pack(low - (rest.mean() if len(rest) else 0.0) > TINY)


HASHERS: dict[str, tuple[str, Callable[[np.ndarray], int]]] = {"ahash": ("aHash", ahash), "dhash": ("dHash", dhash), "phash": ("pHash", phash)}


def find(name: str) -> tuple[str, Callable[[np.ndarray], int]]:
    """(display name, kernel) by name, whatever the case."""
    try:
        return HASHERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown algorithm {name!r}; use one of {', '.join(HASHERS)}") from None


def image_hash(name: str, orientation: int | None = None):
    """A UDF over Spark's image struct: the hash, or null where the image can't be read."""
    kernel = find(name)[1]

    @F.pandas_udf(T.LongType())
    def udf(images: pd.DataFrame) -> pd.Series:
        out = []
        for height, width, channels, data in zip(images["height"], images["width"], images["nChannels"], images["data"], strict=True):
            try:
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                out.append(kernel(raster.to_gray(raster.orient(pixels, orientation or 1))))
            except (ValueError, TypeError):  # an image that can't be decoded is skipped by the caller
                out.append(None)
        return pd.Series(out, dtype="Int64")

    return udf


def register(spark: SparkSession) -> None:
    """Make ahash, dhash and phash SQL functions over image structs."""
    for name in HASHERS:
        spark.udf.register(name, image_hash(name))


# -- over array<double> columns of 64 values, row-major 8 x 8; no Python runs ---------------------------


def _pack(bit: Callable[[Column], Column]) -> Column:
    """Pattern whose bit i is set where bit(i) holds, by a fold over 64 places."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: F.when(F.coalesce(bit(i), F.lit(False)), acc.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(acc))


def array_ahash(values: Column) -> Column:
    mean = F.aggregate(values, F.lit(0e0), lambda acc, v: acc + v) / F.lit(64e0)
    return F.element_at(F.transform(F.array(mean), lambda m: _pack(lambda i: F.get(values, i) >= m)), 1)


def array_dhash(values: Column) -> Column:
    """The last column stands for its own right neighbour, so its bits are never set."""
    return _pack(lambda i: (i % 8 != 7) & (F.get(values, i) > F.get(values, i + 1)))


@functools.cache
def small_basis() -> np.ndarray:
    """8 x 8 matrix that resizes 8 values to 32 bilinearly and takes the first 8 cosine coefficients."""
    at = (np.arange(32) + 0.5) * 8 / 32 - 0.5
    low, w = np.floor(at).astype(int), np.zeros((32, 8))
    np.add.at(w, (np.arange(32), np.clip(low, 0, 7)), 1 - (at - low))
    np.add.at(w, (np.arange(32), np.clip(low + 1, 0, 7)), at - low)
    return cosine_basis() @ w


def array_phash(values: Column) -> Column:
    """Both products with the small basis are folds in a fixed order; the basis is a literal array."""
    basis = F.array(*[F.lit(float(x)) for x in small_basis().reshape(64)])
    zero = F.lit(0e0)
    eight = F.sequence(F.lit(0), F.lit(7))
    sixty_four = F.sequence(F.lit(0), F.lit(63))
    half = F.transform(sixty_four, lambda k: F.aggregate(eight, zero, lambda s, i: s + F.get(basis, (k - k % 8) + i) * F.get(values, i * 8 + k % 8)))
    low = lambda h: F.transform(sixty_four, lambda k: F.aggregate(eight, zero, lambda s, j: s + F.get(basis, (k % 8) * 8 + j) * F.get(h, (k - k % 8) + j)))
    snap = lambda c: F.transform(c, lambda v: F.when(F.abs(v) < TINY, 0e0).otherwise(v))

    def bits(c: Column) -> Column:
        rest = F.filter(F.slice(c, 2, 63), lambda v: v != 0)
        mean = F.when(F.size(rest) == 0, zero).otherwise(F.aggregate(rest, zero, lambda s, v: s + v) / F.size(rest))
        return F.element_at(F.transform(F.array(mean), lambda m: _pack(lambda i: F.get(c, i) - m > TINY)), 1)

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return once(half, lambda h: once(snap(low(h)), bits))


ARRAY_HASHERS = {"ahash": array_ahash, "dhash": array_dhash, "phash": array_phash}


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def text_raster(texts: pd.Series) -> pd.Series:
    """64 counts of a text's code points modulo 64, over the whole text; null gives zeros."""
    count = lambda t: np.bincount(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") % 64, minlength=64).astype(np.int32)
    return texts.map(count, na_action=None) if len(texts) else texts
