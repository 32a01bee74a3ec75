"""Image files made by the tests."""

import struct
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """A PNG of gray (h, w), RGB (h, w, 3) or RGBA (h, w, 4) levels."""
    pixels = np.asarray(pixels, np.uint8)
    kind = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
