import json
import threading
import time
import urllib.request
from urllib.error import HTTPError
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookalike import cli, engine
from lookalike.operators import plan as pl
from lookalike.service import Service, server
from lookalike.sources import images, interchange
from lookalike.streaming.arrivals import current_clusters, watch
from tests.pictures import png


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture()
def folder(tmp_path):
    """Three pictures of one scene in different sizes, another scene, and files that aren't images."""
    root = tmp_path / "pictures"
    (root / "deep/.dot").mkdir(parents=True)
    y, x = np.mgrid[:64, :64]
    scene = (x * 3 + 20 * np.sin(y / 7)).clip(0, 255)
    other = np.random.default_rng(5).integers(0, 256, (64, 64))
    (root / "a.png").write_bytes(png(scene))
    (root / "deep/b, copy.PNG").write_bytes(png(scene.repeat(2, 0).repeat(2, 1)))
    (root / "deep/c.jpg").write_bytes(png(np.stack([scene] * 3, 2)))
    (root / "other.bmp").write_bytes(png(other))
    (root / "broken.jpg").write_text("not an image")
    (root / "note.txt").write_text("text")
    (root / "deep/.dot/h.png").write_bytes(png(other))
    return root


def test_scan(spark, folder):
    names = {r["path"].rpartition("/")[2] for r in images.files(spark, str(folder)).collect()}
    assert names == {"a.png", "b, copy.PNG", "c.jpg", "other.bmp", "broken.jpg"}
    hashed = images.hashed(spark, str(folder), "phash").collect()
    assert {r["path"].rpartition("/")[2]: r["pixels"] for r in hashed} == {"a.png": 4096, "b, copy.PNG": 16384, "c.jpg": 4096, "other.bmp": 4096}
    assert [r["path"].rpartition("/")[2] for r in images.skipped(spark, str(folder), images.hashed(spark, str(folder))).collect()] == ["broken.jpg"]
    facts = {r["path"].rpartition("/")[2]: r["pixels"] for r in images.file_facts(spark, str(folder)).collect()}
    assert facts["broken.jpg"] == -1 and facts["a.png"] == 4096
    assert [x.rpartition("/")[2] for x in images.hidden(str(folder))] == ["h.png"]
    staged, names = images.stage_hidden(str(folder))
    assert images.hashed(spark, staged).count() == 1 and list(names.values())[0].endswith(".dot/h.png")


def test_sql_functions(spark, folder):
    from lookalike.functions.hashers import register

    register(spark)
    images.images(spark, str(folder)).createOrReplaceTempView("pictures")
    assert spark.sql("SELECT ahash(image) AS a, dhash(image) AS d, phash(image) AS p FROM pictures").count() == 4


def test_find_duplicates(spark, folder):
    plan = engine.find_duplicates(spark, str(folder), radius=4).collect()
    assert {(r["path"].rpartition("/")[2], r["action"]) for r in plan} == {("b, copy.PNG", "KEEP"), ("a.png", "DELETE"), ("c.jpg", "DELETE")}


def test_command_line(spark, folder, tmp_path, capsys):
    index, clusters, plan = (str(tmp_path / x) for x in ("hashes.csv", "clusters.csv", "plan.csv"))
    assert cli.main(["hash", str(folder), "--out", index]) == 0
    assert cli.main(["cluster", index, "--radius", "4", "--out", clusters]) == 0
    assert cli.main(["plan", clusters, "--out", plan]) == 0
    assert rows(engine.read_plan(spark, plan), "action") == {("keep",), ("delete",)}
    assert cli.main(["apply", plan, "--quarantine", str(tmp_path / "q")]) == 0
    assert {p.name for p in (tmp_path / "q").iterdir()} == {"a.png", "c.jpg"} and (folder / "deep/b, copy.PNG").exists()
    assert cli.main(["hash", str(folder), "--algo", "nope"]) == 2
    assert cli.main(["hash", str(tmp_path / "none")]) == 2 and cli.main(["cluster", str(tmp_path / "none")]) == 2
    assert cli.main(["plan", str(tmp_path / "none")]) == 1 and cli.main(["nonsense"]) == 2
    assert cli.main([]) == 0 and cli.main(["--version"]) == 0 and "0.0.1" in capsys.readouterr().out


def test_index_files(spark, tmp_path):
    f = tmp_path / "hashes.csv"
    f.write_text("/t/a, b.png,0\n\n/t/c.png, 18446744073709551615 \n,5\nnocomma\n/t/c.png,7\n")
    assert rows(interchange.read_index(spark, str(f)), "path", "hash") == {("/t/a, b.png", 0), ("/t/c.png", 7)}
    f.write_text("/t/a.png,x\n")
    assert interchange.read_index(spark, str(f), strict=False).count() == 0
    with pytest.raises(Exception, match="unsigned"):
        interchange.read_index(spark, str(f)).collect()


def test_cluster_index(spark, tmp_path):
    f = tmp_path / "hashes.csv"
    f.write_text("/t/img1.png,0\n/t/img2.png,0\n/t/img3.png,18446744073709551615\n")
    n = engine.cluster_images(spark, str(f), str(tmp_path / "clusters.csv"), threshold=0.92)
    assert n == {"n_clusters": 2, "n_duplicate_clusters": 1, "n_items": 3}
    assert rows(interchange.read_clusters(spark, str(tmp_path / "clusters.csv")), "path") == {("/t/img1.png",), ("/t/img2.png",)}


def test_plan_files(spark, tmp_path):
    f = tmp_path / "plan.csv"
    f.write_text('clusterId,action,path,reason\n1, DELETE ,"/a, b.png","dupe(pixels=1,size=2)"\n2,what,/c.png\n')
    assert rows(interchange.read_plan(spark, str(f)), "action", "path", "reason") == {("delete", "/a, b.png", "dupe(pixels=1,size=2)"), ("keep", "/c.png", "")}
    f.write_text("clusterId,action,path,reason\n1,KEEP,/a.png,keeper(pixels=1,size=2,mtime=3)\nclusterIdX,KEEP,/b.png,r\n")
    assert rows(interchange.read_plain_plan(spark, str(f)), "clusterId", "reason") == {("1", "keeper(pixels=1,size=2,mtime=3)"), ("clusterIdX", "r")}
    f.write_text("clusterId,action,path,reason\n")
    assert interchange.read_plan(spark, str(f)).count() == 0
    body = '[{"clusterId": "1", "action": "keep", "path": "p", "reason": "r"}]'
    got = spark.createDataFrame([(body,)], "b string").select(F.explode(interchange.plan_from_json(F.col("b"))).alias("r")).select("r.*")
    assert json.loads(interchange.plan_json(got.withColumnRenamed("clusterId", "cluster_id")).first()["json"]) == json.loads(body)[0]
    assert interchange.in_own_folder("a/b.csv") == "a/b.csv"


def test_plans_in_either_form(spark, tmp_path):
    from lookalike import engine
    from lookalike.service import Service

    f = tmp_path / "old.csv"
    f.write_text("clusterId,action,path,reason\n1,keep,/a.png,keeper(pixels=1,size=2,mtime=3)\n1,DELETE,/b.png,r\n")
    want = {("1", "/a.png", "keeper(pixels=1,size=2,mtime=3)"), ("1", "/b.png", "r")}
    assert rows(engine.read_plan(spark, str(f)), "cluster_id", "path", "reason") == want
    service = Service(spark, plan=str(f))
    assert service.update_plan('[{"clusterId": "7", "action": "DELETE", "path": "/x, y.png"}]') == (200, "OK")
    assert rows(engine.read_plan(spark, str(f)), "cluster_id", "path", "reason") == {("7", "/x, y.png", "")}
    assert service.update_plan("nothing")[0] == 400 and engine.read_plan(spark, str(f)).count() == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lookalike.plans import stage_table

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(RuntimeError):
        stage_table.shared_dir(session)


def test_own_folder(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert "/.dup" in interchange.in_own_folder("x.csv") and next(tmp_path.iterdir()).name.startswith(".dup")


def call(port, method, path, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", method=method, data=body.encode() if body is not None else None)) as r:
            return r.status, r.read(), r.headers["Content-Type"]
    except HTTPError as e:
        return e.code, e.read(), ""


def test_service(spark, folder, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    running = server(Service(spark), 0)
    port = running.server_address[1]
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def finished(answer):
        job = json.loads(answer[1])["jobId"]
        for _ in range(240):
            state = json.loads(call(port, "GET", f"/api/job/{job}")[1])
            if state["status"] != "running":
                return state
            time.sleep(0.5)

    try:
        assert call(port, "GET", "/")[0] == 200 and call(port, "GET", "/api/clusters")[1] == call(port, "GET", "/api/plan")[1] == b"[]"
        assert call(port, "POST", "/api/process", "")[0] == 400 and call(port, "POST", "/api/apply", "")[0] == 400
        assert call(port, "GET", "/api/job/none")[0] == 404 and call(port, "GET", "/nowhere")[0] == 404
        state = finished(call(port, "POST", f"/api/process?directory={quote(str(folder))}&threshold=0.93", ""))
        assert (state["status"], state["progress"]) == ("completed", 100)
        (cluster,) = json.loads(call(port, "GET", "/api/clusters")[1])
        assert len(cluster["files"]) == 3 and all(f["size"] > 0 and f["modified"] > 0 for f in cluster["files"])
        plan = json.loads(call(port, "GET", "/api/plan")[1])
        assert sorted(r["action"] for r in plan) == ["delete", "delete", "keep"]
        image = call(port, "GET", "/api/image?path=" + quote(str(folder / "a.png")))
        assert image[0] == 200 and image[2] == "image/png" and image[1][:4] == b"\x89PNG"
        assert call(port, "GET", "/api/image")[0] == 400 and call(port, "GET", "/api/image?path=" + quote(str(folder / "other.bmp")))[0] == 404
        for r in plan:
            r["action"] = "KEEP" if r["path"].endswith("c.jpg") else r["action"]
        before = call(port, "GET", "/api/plan")[1]
        for bad in ("not json", "{}", "[1]", '[{"path": "x"}]', ""):
            assert call(port, "POST", "/api/plan/update", bad)[0] == 400
        assert call(port, "GET", "/api/plan")[1] == before and b"presets" in call(port, "GET", "/")[1]
        assert call(port, "POST", "/api/plan/update", json.dumps(plan))[1] == b"OK"
        assert finished(call(port, "POST", "/api/apply", ""))["result"] == "1 files moved"
        assert [p.name for p in (tmp_path / "quarantine").iterdir()] == ["a.png"]
        empty = tmp_path / "empty"
        empty.mkdir()
        assert finished(call(port, "POST", f"/api/process?directory={quote(str(empty))}", ""))["status"] == "completed"
    finally:
        running.shutdown()


def test_watch(spark, folder, tmp_path):
    places = [str(tmp_path / x) for x in ("index", "links", "check")]
    watch(spark, str(folder), *places, radius=4).awaitTermination()
    assert rows(current_clusters(spark, *places[:2]).groupBy("cluster").count(), "count") == {(3,), (1,)}


def test_unknown_files_rank_last(spark):
    c = spark.createDataFrame([("1", "/none/a.png"), ("1", "/none/b.png")], "cluster_id string, path string")
    facts = spark.createDataFrame([], "path string, pixels long, size long, mtime long")
    assert [r["action"] for r in pl.make_plan(c, facts).orderBy("path").collect()] == ["KEEP", "DELETE"]
