"""Raster kernels on numpy arrays: gray levels, resizing, orientation, luma.

Rasters are uint8 arrays of height x width, with a last axis of 1 (gray), 3 (BGR) or 4 (BGRA) channels, as
Spark's image source gives them.
"""

from __future__ import annotations

import functools

import numpy as np


def to_gray(image: np.ndarray) -> np.ndarray:
    """Gray levels: integer luma of the colour, composited over black where there is alpha."""
    if image.ndim == 2:
        return image
    if image.shape[2] == 1:
        return image[:, :, 0]
    levels = image.astype(np.int32)
    b, g, r = levels[:, :, 0], levels[:, :, 1], levels[:, :, 2]
    if image.shape[2] == 4:
        a = levels[:, :, 3]
        r, g, b = ((x * a + 127) // 255 for x in (r, g, b))
    return ((77 * r + 150 * g + 29 * b + 128) >> 8).astype(np.uint8)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear samples at the centres of the target's pixels; the ratio of sides isn't kept."""
    if width <= 0 or height <= 0:
        raise ValueError(f"target size {width} x {height} is empty")

    def taps(old: int, new: int):
        at = (np.arange(new) + 0.5) * old / new - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, old - 1), np.clip(low + 1, 0, old - 1), at - low

    x0, x1, fx = taps(gray.shape[1], width)
    y0, y1, fy = taps(gray.shape[0], height)
    g = gray.astype(np.float64)
    rows0 = g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx
    rows1 = g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx
    return np.floor(rows0 * (1 - fy[:, None]) + rows1 * fy[:, None] + 0.5).astype(np.uint8)


@functools.cache
def shown_levels() -> np.ndarray:
    """The sRGB level that each linear gray level reads back as."""
    t = np.arange(256) / 255.0
    return np.floor(255.0 * np.where(t <= 0.0031308, 12.92 * t, 1.055 * t ** (1 / 2.4) - 0.055) + 0.5).astype(np.int64)


@functools.cache
def luma_levels() -> tuple[np.ndarray, np.ndarray]:
    """Luma of each gray level read back, truncated to an integer, and as a share of 255. The products
    are summed in the order of red, green, blue, as truncation depends on the last bit."""
    v = shown_levels().astype(np.float64)
    luma = 0.299 * v + 0.587 * v + 0.114 * v
    return luma.astype(np.int64), luma / 255.0


def orient(image: np.ndarray, orientation: int) -> np.ndarray:
    """Apply an orientation of 1 to 8; others leave the raster as it is."""
    if orientation == 2:
        return image[:, ::-1]
    if orientation == 3:
        return image[::-1, ::-1]
    if orientation == 4:
        return image[::-1]
    if orientation in (5, 6, 7, 8):
        turned = image.swapaxes(0, 1)
        return {5: turned, 6: turned[:, ::-1], 7: turned[::-1, ::-1], 8: turned[::-1]}[orientation]
    return image


def read_orientation(path: str) -> int:
    """Stored orientations are not read: every file counts as upright. Pass orientations explicitly."""
    return 1
