import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookalike.operators import clusters as cl
from lookalike.operators import plan as pl
from lookalike.operators import quarantine
from lookalike.operators import similarity as sim
from lookalike.operators.components import components
from lookalike.streaming.arrivals import add_batch

ITEMS = "path string, hash long"


def planted(n=600, seed=3):
    rng, out = random.Random(seed), []
    for i in range(n):
        h = rng.getrandbits(64) if i % 3 or not out else out[rng.randrange(len(out))]
        for _ in range(rng.randrange(6)):
            h ^= 1 << rng.randrange(64)
        out.append(h)
    return [(f"p{i:04d}", h - (1 << 64) if h >> 63 else h) for i, h in enumerate(out)]


def brute_pairs(items, r):
    hs = sorted({h for _, h in items})
    return {(a, b) for i, a in enumerate(hs) for b in hs[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= r}


@pytest.mark.parametrize("strategy,radius", [("theta", 4), ("banded", 0), ("banded", 3), ("banded", 10), ("multi", 6), ("multi", 9), ("auto", 5)])
def test_pairs(spark, strategy, radius):
    items = planted()
    got = sim.hash_pairs(spark.createDataFrame(items, ITEMS), radius, strategy).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == brute_pairs(items, radius)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() == r["distance"] for r in got)


def test_multi_is_exact_for_wide_radii(spark):
    items = planted(200, 9)
    for radius in (16, 20):
        got = sim.hash_pairs(spark.createDataFrame(items, ITEMS), radius, "multi")
        assert {(r["a"], r["b"]) for r in got.collect()} == brute_pairs(items, radius)


def test_radius_ladder(spark):
    items = spark.createDataFrame([(str(i), h) for i, h in enumerate((0b11110000, 0b11110001, 0b11110011, 0b11111111, 0), 1)], ITEMS)
    probe = items.where("path = '1'").select(F.col("path").alias("probe"), "hash")
    assert [sim.within(items, probe, r).count() for r in range(5)] == [1, 2, 3, 3, 5]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert sim.within(items, probe, -1).count() == 0


def test_item_pairs(spark):
    items = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3), ("d", 255)], ITEMS)
    assert {tuple(r) for r in sim.item_pairs(items, 1).collect()} == {("a", "b", 0), ("a", "c", 1), ("b", "c", 1)}
    assert sim.item_pairs(items, -1).count() == 0


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)]
    loose = [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(160)]
    edges = chain + star + loose + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters(spark):
    items = planted(300, 5)
    df = spark.createDataFrame(items, ITEMS)
    for radius in (0, 3, 10):
        pairs = brute_pairs(items, radius)
        label = union_find(pairs)
        groups = {}
        for p, h in items:
            groups.setdefault(label.get(h, h), []).append(p)
        want = {p: min(g) for g in groups.values() for p in g}
        got = cl.cluster(df, radius)
        assert {r["path"]: r["cluster_id"] for r in got.collect()} == want
        s = cl.summary(got).first()
        assert tuple(s) == (len(groups), sum(len(g) > 1 for g in groups.values()), len(items))
        assert cl.duplicates(got).count() == sum(len(g) for g in groups.values() if len(g) > 1)
    with pytest.warns(UserWarning):
        assert cl.cluster(df, -1).where("cluster_id <> path").count() == 0
    assert cl.cluster(df, 64).select("cluster_id").distinct().count() == 1
    assert cl.members(cl.cluster(df, 0)).select(F.explode("members")).count() == len(items)


def test_plan_order(spark):
    rows = spark.createDataFrame([("c", x) for x in ("small", "Big", "mid", "gone")], "cluster_id string, path string")
    facts = spark.createDataFrame([("Big", 160000, 9, 3000), ("mid", 40000, 9, 1000), ("small", 10000, 9, 2000)], "path string, pixels long, size long, mtime long")
    assert [r["path"] for r in pl.ranked(rows, facts).orderBy("rank").collect()] == ["Big", "mid", "small", "gone"]
    plan = {r["path"]: r for r in pl.make_plan(rows, facts).collect()}
    assert {p: r["action"] for p, r in plan.items()} == {"Big": "KEEP", "mid": "DELETE", "small": "DELETE", "gone": "DELETE"}
    assert plan["Big"]["reason"] == "keeper(pixels=160000,size=9,mtime=3000)" and plan["gone"]["reason"].startswith("dupe(pixels=-1,size=-1,mtime=9223372036854775807")


def test_review(spark):
    files = spark.createDataFrame([(1, "a", 5, 9), (1, "b", 7, 0), (1, "c", 7, 3), (2, "d", 0, 0)], "cluster_id long, path string, size long, mtime long")
    auto = {r["path"]: r["action"] for r in pl.auto_select(files).collect()}
    assert auto == {"a": "delete", "b": "keep", "c": "delete", "d": "keep"}
    marks = {r["path"]: (r["is_largest"], r["is_oldest"]) for r in pl.badges(files).collect()}
    assert marks == {"a": (False, False), "b": (True, False), "c": (False, True), "d": (False, False)}
    plan = pl.auto_select(files)
    assert pl.set_all(plan, "delete", 1).where("action = 'delete'").count() == 3
    assert [r["cluster_id"] for r in pl.without_keeper(pl.set_all(plan, "delete", 1)).collect()] == [1]
    assert pl.toggle(plan, 1, "a").where("path = 'a'").first()["action"] == "keep"
    assert pl.set_one(plan, 1, "b", "delete").where("path = 'b'").first()["reason"] == "Manual selection"
    assert tuple(pl.stats(plan).first()) == (2, 4, 2, 2)
    assert {r["path"]: r["keeper"] for r in pl.with_keepers(plan).collect()} == {"a": "b", "c": "b"}
    assert pl.reviewed(files, plan.where("path = 'a'")).where("action = 'delete'").count() == 1
    assert pl.or_auto(plan.limit(0), files).count() == 4
    listed = {r["id"]: r["files"] for r in pl.listing(files.select("cluster_id", "path"), files.where("path <> 'a'").select("path", "size", "mtime")).collect()}
    assert [tuple(x) for x in listed[1]] == [("a", 0, 0), ("b", 7, 0), ("c", 7, 3)]


def test_free_names():
    taken = {"file.png"}
    first = quarantine.free_name("file.png", taken)
    taken.add(first)
    assert (first, quarantine.free_name("file.png", taken)) == ("file_1.png", "file_2.png")
    assert quarantine.free_name(".hidden", {".hidden"}) == ".hidden_1"


def test_apply(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "file.png").write_text(folder)
    rows = [(1, "KEEP", str(tmp_path / "keep.png")), (1, "DELETE", str(tmp_path / "x/file.png")), (1, "delete", str(tmp_path / "y/file.png"))]
    plan = spark.createDataFrame(rows, "cluster_id long, action string, path string")
    target = tmp_path / "q"
    target.mkdir()
    (target / "file.png").write_text("there")
    assert {r["status"] for r in quarantine.apply_plan(plan, str(target))} == {"planned"} and (tmp_path / "x/file.png").exists()
    moved = list(quarantine.apply_plan(plan, str(target), dry_run=False))
    assert [r["status"] for r in moved] == ["moved", "moved"] and {p.name for p in target.iterdir()} == {"file.png", "file_1.png", "file_2.png"}
    assert moved[0]["keeper"].endswith("keep.png")
    with pytest.raises(OSError):
        list(quarantine.apply_plan(plan, str(target), dry_run=False))
    with pytest.warns(UserWarning, match="hardlink"):
        again = list(quarantine.apply_plan(plan, str(target), dry_run=False, stop_on_error=False, hardlink=True))
    assert all(r["status"].startswith("error") for r in again)
    with pytest.raises(ValueError, match="lose all"):
        list(quarantine.apply_plan(plan.where("action <> 'KEEP'"), str(target)))


def test_add_batch(spark):
    index = spark.createDataFrame([("a", 0), ("b", 7)], ITEMS)
    new = spark.createDataFrame([("c", 1), ("d", 3)], ITEMS)
    links = add_batch(index, spark.createDataFrame([], "a long, b long"), new, 1)
    assert {tuple(r) for r in links.collect()} == {(0, 1), (1, 3), (3, 7)}
    assert np.all([r["a"] < r["b"] for r in links.collect()])
