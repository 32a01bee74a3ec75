import numpy as np
import pytest
from pyspark.sql import functions as F

from lookalike.functions import hashers, raster, scalars
from lookalike.functions.u64 import format_u64, parse_u64


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_u64_text(spark):
    for bits, text in ((0, "0"), (-1, "18446744073709551615"), (-(2**63), "9223372036854775808"), (2**63 - 1, "9223372036854775807")):
        assert one(spark, format_u64(F.lit(bits).cast("long"))) == text
        assert one(spark, parse_u64(F.lit(text))) == bits
    assert one(spark, parse_u64(F.lit("+7"))) == 7
    assert one(spark, parse_u64(F.lit("0000000000000000000000012"))) == 12


@pytest.mark.parametrize("text", ["abc", "1.5", "-1", "18446744073709551616", ""])
def test_u64_refuses(spark, text):
    assert one(spark, parse_u64(F.lit(text), strict=False)) is None
    with pytest.raises(Exception, match="unsigned"):
        one(spark, parse_u64(F.lit(text)))


def test_hamming_and_radius(spark):
    low, high = -(2**63), 2**63 - 1
    for a, b, d in ((10, 13, 3), (0, -1, 64), (low, high, 64), (0, high, 63), (0, 3, 2)):
        assert one(spark, scalars.hamming(F.lit(a).cast("long"), F.lit(b).cast("long"))) == d
    for t, r in ((1.0, 0), (0.95, 3), (0.9, 6), (0.85, 10), (0.5, 32)):
        assert one(spark, scalars.radius_of(F.lit(t))) == r


def test_names_and_labels(spark):
    lit = F.lit
    assert one(spark, scalars.stem(lit(".bashrc"))) == ".bashrc" and one(spark, scalars.extension(lit("a.b.png"))) == ".png"
    assert one(spark, scalars.media_type(lit("x/Y.JPEG"))) == "image/jpeg" and one(spark, scalars.media_type(lit("x"))) == scalars.OTHER_TYPE
    assert one(spark, scalars.normal_action(lit(" DELETE "))) == "delete" and one(spark, scalars.normal_action(lit(None).cast("string"))) == "keep"
    assert one(spark, scalars.size_label(lit(2048))) == "2 KB" and one(spark, scalars.size_label(lit(3 * 1048576))) == "3.00 MB"
    assert one(spark, scalars.tidy_path(lit("/a//b/"))) == "/a/b" and one(spark, scalars.base_name(lit(r"c:\x\y.png"))) == "y.png"
    assert one(spark, scalars.url_component(lit("a b&c"))) == "a%20b%26c"
    assert one(spark, scalars.reason("keeper", lit(1), lit(2), lit(3))) == "keeper(pixels=1,size=2,mtime=3)"
    assert one(spark, scalars.day_label(lit(86_400_000).cast("long"))) == "1970-01-02 00:00:00"


def test_golden_hashes():
    black, white, gray = (np.full((16, 16), v, np.uint8) for v in (0, 255, 0x80))
    assert hashers.ahash(black) == hashers.ahash(white) == -1
    assert hashers.dhash(black) == hashers.dhash(white) == 0
    assert [hashers.phash(x) for x in (black, white, gray)] == [0, 1, 1]
    y, x = np.mgrid[:8, :8]
    assert hashers.ahash(np.where((x + y) % 2 == 0, 255, 0).astype(np.uint8)) == -6172840429334713771
    assert hashers.dhash(np.tile(255 - 20 * np.arange(9), (8, 1)).astype(np.uint8)) == -1


def test_levels():
    shown, luma = raster.shown_levels(), raster.luma_levels()[0]
    assert shown[128] == 188 and len(np.unique(shown)) == 183
    assert luma[255] == 255 and ((shown - luma) <= 1).all() and (luma <= shown).all()


def test_gray_and_resize():
    assert raster.to_gray(np.array([[[0, 0, 0, 0x80], [255, 255, 255, 0x80]]], np.uint8)).tolist() == [[0, 128]]
    assert raster.to_gray(np.array([[[10, 20, 30]]], np.uint8))[0, 0] == (77 * 30 + 150 * 20 + 29 * 10 + 128) >> 8
    image = np.random.default_rng(1).integers(0, 256, (41, 57)).astype(np.uint8)
    assert (raster.resize(image, 57, 41) == image).all() and raster.resize(image, 9, 8).shape == (8, 9)
    for size in ((0, 5), (5, 0)):
        with pytest.raises(ValueError):
            raster.resize(image, *size)


def test_orientations():
    rgbw = np.array([["R", "G"], ["B", "W"]])
    for k, text in ((1, "RGBW"), (2, "GRWB"), (3, "WBGR"), (4, "BWRG"), (5, "RBGW"), (6, "BRWG"), (7, "WGBR"), (8, "GWRB"), (9, "RGBW")):
        assert "".join(raster.orient(rgbw, k).reshape(-1)) == text
    assert raster.orient(np.zeros((2, 3)), 6).shape == (3, 2) and raster.read_orientation("x") == 1


def test_array_hashes_follow_kernels(spark):
    values = np.random.default_rng(2).random((40, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "i long, v array<double>")
    got = df.select("i", *[h(F.col("v")).alias(n) for n, h in hashers.ARRAY_HASHERS.items()]).collect()
    c = hashers.small_basis()
    for r in got:
        v = values[r["i"]].reshape(8, 8)
        assert r["ahash"] == hashers.pack(v >= v.mean())
        assert r["dhash"] == hashers.pack(np.hstack([v[:, :-1] > v[:, 1:], np.zeros((8, 1), bool)]))
        low = (c @ v @ c.T).reshape(64)
        assert r["phash"] == hashers.pack(low - low[1:].mean() > hashers.TINY)


def test_unknown_hasher():
    assert hashers.find("AHASH")[0] == "aHash"
    with pytest.raises(ValueError, match="unknown algorithm"):
        hashers.find("xhash")
