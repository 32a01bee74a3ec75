"""Hamming similarity joins over 64-bit hashes.

Items with equal hashes are one node, so the join runs over distinct hashes. ``banded``: two hashes within
radius r agree in at least one of r + 1 bands of bits, so an equi-join on bands finds all pairs, which are
then verified; a pair is kept for its first common band only, so no distinct is needed. ``multi``: with
fewer, wider bands, each probed with all values within radius r // bands of the band's own, wide radii stay
equi-joins (Norouzi et al. 2012). ``theta`` compares all pairs and fits small inputs.
"""

from __future__ import annotations

import itertools
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hamming

#: Up to so many distinct hashes all pairs are compared.
THETA_NODES = 20_000
#: Up to this radius bands of r + 1 are wide enough to be selective.
BANDED_RADIUS = 4


def nodes(items: DataFrame) -> DataFrame:
    """(hash, n, first_path, last_path) of each distinct hash; joining on hash gives its items, which are
    not gathered into a list, as one hash may hold much of the table."""
    return items.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def bands(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n bands that cover 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _band(h: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _theta(hashes: DataFrame, radius: int) -> DataFrame:
    a, b = hashes.select(F.col("hash").alias("a")), hashes.select(F.col("hash").alias("b"))
    d = hamming(F.col("a"), F.col("b"))
    return a.join(b, (F.col("a") < F.col("b")) & (d <= radius)).select("a", "b", d.alias("distance"))


def _between(one: DataFrame, two: DataFrame, radius: int, n_bands: int, probe: int) -> DataFrame:
    """(a, b, distance) of the hashes a of ``one`` and b of ``two`` within ``radius``, each pair once, as an
    equi-join on bands: two such hashes differ in at most ``probe`` bits of some band."""
    cut = bands(n_bands)
    own = F.array(*[F.struct(F.lit(i).alias("i"), _band(F.col("hash"), *c).alias("v")) for i, c in enumerate(cut)])
    flips = lambda w: [sum(1 << k for k in x) for n in range(probe + 1) for x in itertools.combinations(range(w), n)]

    def probes(i: int, at: int, width: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in flips(width)])
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("i"), _band(F.col("hash"), at, width).bitwiseXOR(m).alias("v")))

    near = F.flatten(F.array(*[probes(i, *c) for i, c in enumerate(cut)])) if probe else own
    left = one.select(F.col("hash").alias("a"), F.explode(near).alias("k")).select("a", "k.i", "k.v")
    right = two.select(F.col("hash").alias("b"), F.explode(own).alias("k")).select("b", "k.i", "k.v")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(F.bit_count(_band(x, *c)) <= probe, F.lit(i)) for i, c in enumerate(cut)])
    d = F.bit_count(x)
    return left.join(right, ["i", "v"]).where((d <= radius) & (first == F.col("i"))).select("a", "b", d.cast("int").alias("distance"))


def _banded(hashes: DataFrame, radius: int, n_bands: int, probe: int) -> DataFrame:
    return _between(hashes, hashes, radius, n_bands, probe).where(F.col("a") < F.col("b"))


def _plan(radius: int) -> tuple[int, int]:
    """Number of bands, and bits that a probe may differ in: some hundreds of probes a hash at most for radii
    up to 23."""
    if radius <= BANDED_RADIUS:
        return min(64, radius + 1), 0
    n = max(2, min(8, (radius + 2) // 2)) if radius < 16 else 8
    return n, radius // n


def pairs_between(one: DataFrame, two: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance) of the distinct hashes of two tables within ``radius``. Radii of 24 or more, where bands
    no longer tell hashes apart, compare all."""
    one, two = (x.select("hash").where("hash is not null").distinct() for x in (one, two))
    if 0 <= radius < 24:
        return _between(one, two, radius, *_plan(radius))
    d = hamming(F.col("a"), F.col("b"))
    return one.select(F.col("hash").alias("a")).join(two.select(F.col("hash").alias("b")), d <= radius).select("a", "b", d.alias("distance"))


def hash_pairs(hashes: DataFrame, radius: int, strategy: str = "auto", n_nodes: int | None = None) -> DataFrame:
    """(a, b, distance), a < b, of the distinct hashes within ``radius``."""
    hashes = hashes.select("hash").where("hash is not null").distinct()
    if radius < 1 or radius >= 64 and strategy == "auto":
        strategy = "theta" if radius >= 64 else "none"
    if strategy == "auto":
        n = hashes.count() if n_nodes is None else n_nodes
        strategy = "theta" if n <= THETA_NODES else "banded" if radius <= BANDED_RADIUS else "multi"
    if strategy == "none":
        return hashes.select(F.col("hash").alias("a"), F.col("hash").alias("b"), F.lit(0).alias("distance")).where("a < b")
    if strategy == "theta":
        return _theta(hashes, radius)
    if strategy == "banded":
        return _banded(hashes, radius, min(64, radius + 1), 0)
    if strategy == "multi":
        n = max(2, min(8, (radius + 2) // 2)) if radius < 16 else 8
        return _banded(hashes, radius, n, radius // n)
    raise ValueError(f"unknown strategy {strategy!r}")


def item_pairs(items: DataFrame, radius: int, strategy: str = "auto") -> DataFrame:
    """(left_path, right_path, distance) of all pairs of items within ``radius``, left before right.
    The rows grow with the square of a group of equal hashes; clustering works on nodes instead."""
    if radius < 0:
        return items.select(F.col("path").alias("left_path"), F.col("path").alias("right_path"), F.lit(0).alias("distance")).limit(0)
    one, two = (items.select(F.col("path").alias(p), F.col("hash").alias(h)) for p, h in (("left_path", "a"), ("right_path", "b")))
    equal = one.join(two, F.col("a") == F.col("b")).where("left_path < right_path").select("left_path", "right_path", F.lit(0).alias("distance"))
    near = hash_pairs(items, radius, strategy).join(one, "a").join(two, "b")
    return equal.union(near.select(F.least("left_path", "right_path").alias("left_path"), F.greatest("left_path", "right_path").alias("right_path"), "distance"))


def within(items: DataFrame, probes: DataFrame, radius: int) -> DataFrame:
    """(probe, path, distance) of the items within ``radius`` of each probe (probe, hash), an item's own
    among them; a negative radius finds nothing."""
    if radius < 0:
        warnings.warn(f"radius {radius} finds nothing", stacklevel=2)
    near = pairs_between(probes, items, radius).withColumnsRenamed({"a": "_probe", "b": "hash"})
    own = probes.select("probe", F.col("hash").alias("_probe"))
    return near.join(own, "_probe").join(items.select("path", "hash"), "hash").select("probe", "path", "distance")
