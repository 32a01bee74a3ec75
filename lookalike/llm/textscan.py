"""Word hashing over the UTF-8 buffers of Arrow columns, without making Python strings.

A word boundary is a byte, so the rule for words (runs without ASCII white space) works on bytes. A
word's hash joins two polynomials over its bytes, with bases chosen at random and the prime modulus 2^31 - 1;
it depends on the word alone. Two different words of n bytes agree in both with a chance of at most
(n / 2^31)^2, whatever their form. Runs of words are hashed by joining the hashes of their halves, with a
mixing step at each join. Columns are scanned in slices of a bounded number of bytes, so that one batch of
long texts needs bounded memory; a single text longer than a slice is a slice of its own, whose words are
hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
PRIME = (1 << 31) - 1
#: Bases of the two polynomials, drawn once.
BASES = (1_340_862_761, 762_113_947)
SLICE_BYTES = 1 << 20
#: Products of values and powers are below 2^41 for bytes, so that sums over so many don't overflow.
MOST_TERMS = 1 << 22

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _finish(h: np.ndarray) -> np.ndarray:
    """``mixed`` in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finisher for 64-bit hashes."""
    return _finish(h ^ U64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pairs of two arrays' hashes; the order matters."""
    h = a * GOLDEN
    h ^= h >> U64(32)
    h += b
    return _finish(h)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours, from those of 1, 2, 4, ... neighbours."""
    out, have, power, size = None, 0, hashes, 1
    while True:
        if k & size:
            if out is None:
                out = power
            else:
                more = power[have:]
                out = paired(out[: len(more)], more)
            have += size
        if 2 * size > k:
            return out[: max(0, len(hashes) - k + 1)]
        power, size = paired(power[:-size], power[size:]), 2 * size


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    x = (x & U64(PRIME)) + (x >> U64(31))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


class _Powers:
    """Powers of a number modulo PRIME, made as far as they are asked for."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, U64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            step = U64(pow(self.base, len(self.have), PRIME))
            self.have = np.concatenate([self.have, _reduced(self.have * step)])
        return self.have[:n]


_up = [_Powers(b) for b in BASES]
_down = [_Powers(pow(b, -1, PRIME)) for b in BASES]


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes data[start:end] for each span, the same wherever the span stands."""
    values, both = data.astype(U64) + U64(1), []
    for up, down in zip(_up, _down, strict=True):
        sums = np.zeros(len(values) + 1, U64)
        products = values * up(len(values))
        np.cumsum(products if len(values) <= MOST_TERMS else _reduced(products), out=sums[1:])
        both.append(_reduced(_reduced(sums[ends] - sums[starts]) * down(len(values) + 1)[starts]))
    h = (both[0] << U64(32)) | both[1]
    h += (ends - starts).astype(U64) * GOLDEN
    return _finish(h)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of bytes. A long text is worked off in pieces that end between words, as each step
    needs several times eight bytes for every byte."""
    out, lo = np.zeros(len(starts), U64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE_BYTES, "right")))
        begin = starts[lo]
        out[lo:hi] = _spans(data[begin : ends[hi - 1]], starts[lo:hi] - begin, ends[lo:hi] - begin)
        lo = hi
    return out


@dataclass
class Slice:
    """Some rows of a column: rows lo to hi; word arrays; first word of each row (hi - lo + 1 entries)."""

    lo: int
    hi: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(column: pa.Array, lower: bool = False, separators: np.ndarray | None = None) -> Iterator[Slice]:
    """Scan a string column. ``separators``: 256 flags of bytes that end words, white space by default."""
    flags = _space if separators is None else separators
    at, data = buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        own = data[at[lo] : at[hi]]
        if lower:
            own = _lower[own]
        rows = at[lo : hi + 1] - at[lo]
        inside = np.empty(len(own) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(flags[own], out=inside[1:-1])
        edge = np.zeros(len(own) + 1, bool)
        edge[rows] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        hashes = _word_hashes(own, starts, ends)
        yield Slice(lo, hi, own, hashes, starts, ends, np.searchsorted(starts, rows))
        lo = hi


def grams(part: Slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, the word they begin at and their row."""
    n = len(part.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = part.doc_of_word()
    begin = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return runs(part.hashes, k)[begin], begin, doc[begin]
