"""A small HTTP service over the stages, on the standard library's server.

Jobs run one at a time on a worker thread, so they never publish over each other. Only images that the
current clusters name are served.
"""

from __future__ import annotations

import json
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .operators import plan as pl
from .plans.stage_table import exists, scratch
from .sources import images, interchange

PRESETS = {"identical": (1.0, "ahash"), "similar": (0.95, "phash")}
PAGE = Path(__file__).with_name("review.html").read_text(encoding="utf-8").replace("/*PRESETS*/", json.dumps(PRESETS))
PLAN_KEYS = interchange.PLAN_COLUMNS


def plan_rows(body: str) -> list[tuple]:
    """Plan rows of a request's body; ValueError if it is no JSON list of objects that name cluster and path."""
    found = json.loads(body)
    if not isinstance(found, list):
        raise ValueError("the plan must be a list")
    for row in found:
        if not isinstance(row, dict) or not all(isinstance(row.get(k), str) for k in ("clusterId", "path")) or not all(isinstance(row.get(k), str | None) for k in PLAN_KEYS):
            raise ValueError("every row of the plan must name its cluster and path")
    return [tuple(row.get(k) or "" for k in PLAN_KEYS) for row in found]


class Service:
    """State and requests of one server; each method returns (status, body)."""

    def __init__(self, spark: SparkSession, clusters: str | None = None, plan: str | None = None):
        self.spark, self.clusters, self.plan = spark, clusters, plan
        self.jobs: dict[str, dict] = {}
        self.lock, self.writing, self.pool = threading.Lock(), threading.Lock(), ThreadPoolExecutor(1)

    def _start(self, work) -> tuple[int, dict]:
        job = uuid.uuid4().hex
        self._set(job, status="running", progress=0, message="queued")

        def run():
            try:
                self._set(job, status="completed", progress=100, message="done", result=work(lambda p, m: self._set(job, progress=p, message=m)))
            except Exception as e:  # a failed job reports its error and leaves the server up
                self._set(job, status="failed", message="failed", error=str(e))

        self.pool.submit(run)
        return 200, {"jobId": job, "status": "started"}

    def _set(self, job: str, **changes) -> None:
        with self.lock:
            self.jobs[job] = {**self.jobs.get(job, {}), **changes}

    def process(self, directory: str | None, threshold: str = "0.95", algorithm: str = "phash") -> tuple[int, dict]:
        if not directory or not exists(self.spark, directory):
            return 400, {"error": "directory is missing"}
        radius = engine.radius_of(float(threshold))

        def work(tell) -> str:
            index, clusters, plan = (scratch(self.spark, x) for x in ("hashes", "clusters", "plan"))
            tell(10, "hashing")
            engine.hash_images(self.spark, directory, index, algorithm)
            tell(40, "clustering")
            n = engine.cluster_images(self.spark, index, clusters, radius)
            tell(70, "planning")
            engine.generate_plan(self.spark, clusters, plan, directory)
            self.clusters, self.plan = clusters, plan
            return f"{n['n_duplicate_clusters']} clusters with duplicates"

        return self._start(work)

    def job(self, job: str) -> tuple[int, dict]:
        with self.lock:
            found = self.jobs.get(job)
            return (200, dict(found)) if found else (404, {"error": "no such job"})

    def _cluster_rows(self) -> DataFrame | None:
        return interchange.read_clusters(self.spark, self.clusters) if self.clusters and exists(self.spark, self.clusters) else None

    def _plan_rows(self) -> DataFrame | None:
        return engine.read_plan(self.spark, self.plan) if self.plan and exists(self.spark, self.plan) else None

    def list_clusters(self) -> tuple[int, list]:
        rows = self._cluster_rows()
        if rows is None:
            return 200, []
        facts = self.spark.createDataFrame(images.listing_facts([r["path"] for r in rows.select("path").distinct().toLocalIterator()]), "path string, size long, mtime long")
        return 200, [json.loads(x["json"]) for x in pl.listing(rows, facts).select(F.to_json(F.struct("id", "files")).alias("json")).collect()]

    def list_plan(self) -> tuple[int, list]:
        rows = self._plan_rows()
        return 200, [] if rows is None else [json.loads(x["json"]) for x in interchange.plan_json(rows).collect()]

    def update_plan(self, body: str) -> tuple[int, str | dict]:
        """Write the reviewed plan to the plan's own file. A body that is no plan changes nothing."""
        try:
            rows = plan_rows(body)
        except ValueError as e:
            return 400, {"error": f"not a plan: {e}"}
        frame = pl.normalise(self.spark.createDataFrame(rows, interchange.PLAN_SCHEMA).withColumnRenamed("clusterId", "cluster_id"))
        with self.writing:
            target = self.plan or scratch(self.spark, "plan")
            interchange.write_plan(frame, target)
            self.plan = target
        return 200, "OK"

    def apply(self, folder: str = "./quarantine") -> tuple[int, dict]:
        if self._plan_rows() is None:
            return 400, {"error": "there is no plan"}
        return self._start(lambda tell: f"{sum(r['status'] == 'moved' for r in engine.apply_plan(self.spark, self.plan, folder, dry_run=False))} files moved")

    def image(self, path: str | None) -> tuple[int, bytes | dict, str]:
        if not path:
            return 400, {"error": "path is missing"}, "application/json"
        rows = self._cluster_rows()
        found = images.image_bytes(self.spark, path, rows) if rows is not None and exists(self.spark, path) else None
        return (200, *found) if found else (404, {"error": "no such image"}, "application/json")

    def answer(self, method: str, target: str, body: str = "") -> tuple[int, bytes, str]:
        """Status, content and media type of a request."""
        url, kind = urlsplit(target), "application/json"
        args = {k: v[0] for k, v in parse_qs(url.query).items()}
        try:
            match (method, url.path):
                case ("GET", "/" | "/index.html"):
                    return 200, PAGE.encode(), "text/html"
                case ("POST", "/api/process"):
                    args = args or {k: v[0] for k, v in parse_qs(body).items()}
                    status, out = self.process(args.get("directory"), args.get("threshold", "0.95"), args.get("algo", "phash"))
                case ("GET", "/api/clusters"):
                    status, out = self.list_clusters()
                case ("GET", "/api/plan"):
                    status, out = self.list_plan()
                case ("POST", "/api/plan/update"):
                    status, out = self.update_plan(body)
                case ("POST", "/api/apply"):
                    status, out = self.apply()
                case ("GET", "/api/image"):
                    status, out, kind = self.image(args.get("path"))
                case ("GET", path) if path.startswith("/api/job/"):
                    status, out = self.job(path.removeprefix("/api/job/"))
                case _:
                    status, out = 404, {"error": "no such route"}
        except Exception as e:  # a failed request is answered, and the server stays up
            status, out, kind = 500, {"error": str(e)}, "application/json"
        return status, out if isinstance(out, bytes) else out.encode() if isinstance(out, str) else json.dumps(out).encode(), kind


def server(service: Service, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, content, kind = service.answer(self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        do_GET = do_POST = _do

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(service: Service, port: int) -> None:
    with server(service, port) as running:
        running.serve_forever()
