"""The engine's queries by name, with the SQL that DuckDB runs for the same rows.

The tables hold no images, so items are made from them: ``embeddings`` are 8 x 8 rasters of floats, and
``documents`` become 8 x 8 rasters of the counts of their code points modulo 64, over the whole text. File
facts stand in columns: pixels is n_chars, size the text's length, mtime follows from doc_id; a path is the
source, the id, and one of five extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashers, scalars
from ..functions.raster import orient
from ..functions.u64 import format_u64, parse_u64
from ..operators import clusters as cl
from ..operators import plan as pl
from ..operators import quarantine
from ..operators import similarity as sim
from ..operators.components import components
from ..sources import interchange
from .stage_table import cut, scratch

#: Extensions by doc_id modulo 5.
ENDINGS = (".jpg", ".PNG", ".bmp", ".txt", ".gif")
#: Hamming radius of the document queries, and of those over embeddings, which lie far apart.
RADIUS, FAR_RADIUS = 1, 20
PROBE_EVERY = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- items ---------------------------------------------------------------------------------------


def doc_path():
    endings = F.array(*[F.lit(x) for x in ENDINGS])
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.element_at(endings, (F.col("doc_id") % 5 + 1).cast("int")))


def doc_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(doc_path().alias("path"), F.col("n_chars").alias("pixels"), F.length("text").cast("long").alias("size"), (F.col("doc_id") * 37 % 1000 + 1).alias("mtime"))


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, hash): aHash of the text's raster."""
    values = hashers.text_raster("text").cast("array<double>")
    return _table(spark, sf_dir, "documents").select(doc_path().alias("path"), values.alias("v")).select("path", hashers.array_ahash(F.col("v")).alias("hash"))


def vec_items(spark: SparkSession, sf_dir: str, name: str = "ahash") -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", hashers.ARRAY_HASHERS[name](F.col("v")).alias("hash"))


def doc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.cluster(cut(doc_items(spark, sf_dir)), RADIUS)


def doc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.make_plan(cl.duplicates(doc_clusters(spark, sf_dir)), doc_facts(spark, sf_dir))


#: As the page sees it: lower-case actions.
def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.duplicates(doc_clusters(spark, sf_dir)).select("cluster_id", "path").join(doc_facts(spark, sf_dir), "path")


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


# -- SQL of the items -------------------------------------------------------------------------------

_PATH = "source || '/' || doc_id || (['.jpg', '.PNG', '.bmp', '.txt', '.gif'])[doc_id % 5 + 1]"
#: Signed pattern of the bits (p, bit): bit 63 is the sign.
_PACKED = "CAST(SUM(CASE WHEN bit THEN CASE WHEN p = 63 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << p END ELSE 0 END) AS BIGINT)"
_FACTS = f"facts AS (SELECT {_PATH} AS path, n_chars AS pixels, CAST(length(text) AS BIGINT) AS size, doc_id * 37 % 1000 + 1 AS mtime FROM documents)"
_DOCS = f"""
chars AS (SELECT doc_id, source, unnest(string_split(text, '')) AS c FROM documents),
counts AS (SELECT doc_id, unicode(c) % 64 AS p, COUNT(*) AS v FROM chars WHERE c <> '' GROUP BY 1, 2),
grid AS (SELECT doc_id, source, unnest(range(64)) AS p FROM documents),
raster AS (SELECT g.doc_id, g.source, g.p, CAST(COALESCE(v, 0) AS DOUBLE) AS v FROM grid g LEFT JOIN counts c USING (doc_id, p)),
bits AS (SELECT doc_id, source, p, v >= AVG(v) OVER (PARTITION BY doc_id) AS bit FROM raster),
items AS (SELECT {_PATH} AS path, {_PACKED} AS hash FROM bits GROUP BY doc_id, source)"""
_CLUSTERS = f"""{_DOCS},
nodes AS (SELECT DISTINCT hash FROM items),
near AS (SELECT a.hash AS a, b.hash AS b FROM nodes a, nodes b WHERE bit_count(xor(a.hash, b.hash)) <= {RADIUS}),
reach(a, b) AS (SELECT hash, hash FROM nodes UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
label AS (SELECT r.a AS hash, MIN(i.path) AS cluster_id FROM reach r JOIN items i ON i.hash = r.b GROUP BY 1),
clusters AS (SELECT cluster_id, path, hash FROM items JOIN label USING (hash)),
dups AS (SELECT cluster_id, path FROM clusters QUALIFY COUNT(*) OVER (PARTITION BY cluster_id) > 1)"""
_PLAN = f"""{_CLUSTERS}, {_FACTS},
ranked AS (SELECT cluster_id, path, pixels, size, mtime, row_number() OVER (PARTITION BY cluster_id ORDER BY pixels DESC, size DESC, mtime, lower(path), path) AS rank FROM dups JOIN facts USING (path)),
plan AS (SELECT cluster_id, CASE WHEN rank = 1 THEN 'KEEP' ELSE 'DELETE' END AS action, path,
  CASE WHEN rank = 1 THEN 'keeper' ELSE 'dupe' END || '(pixels=' || pixels || ',size=' || size || ',mtime=' || mtime || ')' AS reason, pixels, size, mtime FROM ranked)"""
_VECS = "cells AS (SELECT vec_id, unnest(range(64)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE embedding IS NOT NULL)"
_VEC_ITEMS = f"""{_VECS}, bits AS (SELECT vec_id, p, v >= AVG(v) OVER (PARTITION BY vec_id) AS bit FROM cells),
items AS (SELECT vec_id, {_PACKED} AS hash FROM bits GROUP BY 1)"""


# -- scans and scalars -----------------------------------------------------------------------------


@query(f"SELECT path FROM (SELECT {_PATH} AS path FROM documents) WHERE regexp_matches(path, '(?i)^.*\\.(jpg|jpeg|png|bmp)$')")
def scan_filter_ext(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(doc_path().alias("path")).where(scalars.is_image(F.col("path")))


@query(f"SELECT path, CASE WHEN lower(path) LIKE '%.png' THEN 'image/png' WHEN lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.jpeg' THEN 'image/jpeg' WHEN lower(path) LIKE '%.gif' THEN 'image/gif' WHEN lower(path) LIKE '%.bmp' THEN 'image/bmp' WHEN lower(path) LIKE '%.webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS media_type FROM (SELECT {_PATH} AS path FROM documents)")
def mime_type(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(doc_path().alias("path")).withColumn("media_type", scalars.media_type(F.col("path")))


@query(f"SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+)(\\.[^.]*)$', 1) AS stem, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+)(\\.[^.]*)$', 2) AS extension FROM (SELECT {_PATH} AS path FROM documents)")
def path_parts(spark, sf_dir):
    name = scalars.base_name(F.col("path"))
    return _table(spark, sf_dir, "documents").select(doc_path().alias("path")).select("path", name.alias("name"), scalars.stem(name).alias("stem"), scalars.extension(name).alias("extension"))


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 AS threshold, CAST(floor((1e0 - l_discount * 10) * 64e0 + 0.5e0) AS INTEGER) AS radius FROM lineitem")
def threshold_radius(spark, sf_dir):
    t = F.col("l_discount") * 10
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.alias("threshold"), scalars.radius_of(t).alias("radius"))


@query(f"WITH {_VEC_ITEMS} SELECT vec_id, CAST(CASE WHEN hash < 0 THEN CAST(hash AS HUGEINT) + 18446744073709551616 ELSE hash END AS VARCHAR) AS number, hash AS bits FROM items")
def u64_roundtrip(spark, sf_dir):
    rows = vec_items(spark, sf_dir).withColumn("number", format_u64(F.col("hash")))
    return rows.select("vec_id", "number", parse_u64(F.col("number")).alias("bits"))


@query("SELECT doc_id, CASE WHEN lower(trim(a)) IN ('keep', 'delete') THEN lower(trim(a)) ELSE 'keep' END AS action FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' Delete ' WHEN 1 THEN 'KEEP' WHEN 2 THEN 'drop' WHEN 3 THEN NULL ELSE 'delete' END AS a FROM documents)")
def plan_normalize(spark, sf_dir):
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, " Delete ").when(k == 1, "KEEP").when(k == 2, "drop").when(k == 4, "delete")
    return pl.normalise(_table(spark, sf_dir, "documents").select("doc_id", raw.alias("action")))


@query("SELECT o_orderkey, CASE WHEN round(b / 1048576e0, 2) = 0 THEN printf('%d KB', CAST(round(b / 1024e0, 0) AS BIGINT)) ELSE printf('%.2f MB', round(b / 1048576e0, 2)) END AS label FROM (SELECT o_orderkey, CAST(o_orderkey * 137 AS DOUBLE) AS b FROM orders)")
def size_labels(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.size_label(F.col("o_orderkey") * 137).alias("label"))


@query("SELECT doc_id, regexp_replace(regexp_replace(p, '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '//' || doc_id || '/' WHEN 1 THEN '/' || source || '/' || doc_id ELSE source || '///' || doc_id || '//' END AS p FROM documents)")
def tidy_paths(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("//"), i, F.lit("/"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/"), "source", F.lit("/"), i)).otherwise(F.concat("source", F.lit("///"), i, F.lit("//")))
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.tidy_path(raw).alias("path"))


# -- hashes ------------------------------------------------------------------------------------------


@query(f"WITH {_VEC_ITEMS} SELECT vec_id, hash FROM items")
def ahash_embedding(spark, sf_dir):
    return vec_items(spark, sf_dir, "ahash")


@query(f"WITH {_VECS}, bits AS (SELECT vec_id, p, COALESCE(v > lead(v) OVER (PARTITION BY vec_id, p // 8 ORDER BY p), false) AS bit FROM cells) SELECT vec_id, {_PACKED} AS hash FROM bits GROUP BY 1")
def dhash_embedding(spark, sf_dir):
    return vec_items(spark, sf_dir, "dhash")


_BASIS = """
place AS (SELECT y, (y + 0.5e0) / 4e0 - 0.5e0 AS s FROM (SELECT unnest(range(32)) AS y)),
taps AS (SELECT y, LEAST(GREATEST(CAST(floor(s) AS INTEGER), 0), 7) AS i, 1e0 - (s - floor(s)) AS w FROM place UNION ALL SELECT y, LEAST(GREATEST(CAST(floor(s) AS INTEGER) + 1, 0), 7), s - floor(s) FROM place),
basis AS (SELECT u, i, SUM(CASE WHEN u = 0 THEN sqrt(1e0 / 32e0) ELSE sqrt(2e0 / 32e0) END * cos((2e0 * y + 1e0) * u * pi() / 64e0) * w) AS b FROM taps, (SELECT unnest(range(8)) AS u) GROUP BY 1, 2)"""


@query(f"""WITH {_VECS}, {_BASIS},
low AS (SELECT vec_id, r.u * 8 + c.u AS p, SUM(r.b * c.b * v) AS v FROM cells JOIN basis r ON r.i = p // 8 JOIN basis c ON c.i = p % 8 GROUP BY 1, 2),
snap AS (SELECT vec_id, p, CASE WHEN abs(v) < 1e-9 THEN 0e0 ELSE v END AS v FROM low),
bits AS (SELECT vec_id, p, v - COALESCE(AVG(v) FILTER (WHERE p > 0 AND v <> 0) OVER (PARTITION BY vec_id), 0e0) > 1e-9 AS bit FROM snap)
SELECT vec_id, {_PACKED} AS hash FROM bits GROUP BY 1""")
def phash_embedding(spark, sf_dir):
    return vec_items(spark, sf_dir, "phash")


@query(f"WITH {_DOCS} SELECT path, hash FROM items")
def ahash_document(spark, sf_dir):
    return doc_items(spark, sf_dir)


def _turned(p: int, orientation: int) -> int:
    """Index that cell p of an oriented 8 x 8 raster comes from."""
    import numpy as np

    return int(orient(np.arange(64).reshape(8, 8), orientation).reshape(64)[p])


@query("""SELECT vec_id, o AS orientation, list_aggregate(list_transform(range(64), lambda p: CAST(embedding[1 + CASE o WHEN 1 THEN p WHEN 2 THEN (p // 8) * 8 + 7 - p % 8 WHEN 3 THEN 63 - p WHEN 4 THEN (7 - p // 8) * 8 + p % 8
 WHEN 5 THEN (p % 8) * 8 + p // 8 WHEN 6 THEN (7 - p % 8) * 8 + p // 8 WHEN 7 THEN (7 - p % 8) * 8 + 7 - p // 8 ELSE (p % 8) * 8 + 7 - p // 8 END] * 1e6 AS BIGINT) * (p + 1)), 'sum')::BIGINT AS checksum
FROM embeddings, (SELECT unnest(range(1, 9)) AS o) WHERE embedding IS NOT NULL""")
def orientation_maps(spark, sf_dir):
    """Position-weighted sum of each embedding raster in all eight orientations."""
    from_ = F.array(*[F.array(*[F.lit(_turned(p, o)) for p in range(64)]) for o in range(1, 9)])
    rows = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda v: F.rint(v * F.lit(1e6)).cast("long")).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("orientation"))
    index = F.element_at(from_, F.col("orientation"))
    return rows.select("vec_id", F.col("orientation").cast("long").alias("orientation"), F.aggregate(F.transform(index, lambda k, p: F.get("v", k) * (p + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


# -- joins and clusters ------------------------------------------------------------------------------

_PAIRS = f"WITH {_DOCS}, nodes AS (SELECT DISTINCT hash FROM items) SELECT a.hash AS a, b.hash AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM nodes a JOIN nodes b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= "


@query(_PAIRS + "3")
def hamming_pairs_theta(spark, sf_dir):
    return sim.hash_pairs(cut(doc_items(spark, sf_dir)), 3, "theta")


@query(_PAIRS + "3")
def hamming_pairs_banded(spark, sf_dir):
    return sim.hash_pairs(cut(doc_items(spark, sf_dir)), 3, "banded")


@query(_PAIRS + "8")
def hamming_pairs_multi(spark, sf_dir):
    return sim.hash_pairs(cut(doc_items(spark, sf_dir)), 8, "multi")


@query(f"WITH {_VEC_ITEMS} SELECT q.vec_id AS probe, i.vec_id AS path, CAST(bit_count(xor(q.hash, i.hash)) AS INTEGER) AS distance FROM items q JOIN items i ON bit_count(xor(q.hash, i.hash)) <= {FAR_RADIUS} WHERE q.vec_id % {PROBE_EVERY} = 0")
def radius_search(spark, sf_dir):
    items = vec_items(spark, sf_dir).withColumnRenamed("vec_id", "path")
    return sim.within(items, items.where(F.col("path") % PROBE_EVERY == 0).select(F.col("path").alias("probe"), "hash"), FAR_RADIUS)


@query(f"WITH {_DOCS} SELECT hash, COUNT(*) AS n, MIN(path) AS first_path, MAX(path) AS last_path FROM items GROUP BY 1")
def hash_nodes(spark, sf_dir):
    return sim.nodes(doc_items(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_id, path FROM clusters")
def clusters(spark, sf_dir):
    return doc_clusters(spark, sf_dir).select("cluster_id", "path")


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT a AS node, MIN(b) AS component FROM reach WHERE a IN (SELECT a FROM near WHERE a <> b) GROUP BY 1")
def graph_components(spark, sf_dir):
    return components(sim.hash_pairs(cut(doc_items(spark, sf_dir)), RADIUS).select("a", "b"))


@query(f"WITH RECURSIVE {_CLUSTERS}, s AS (SELECT cluster_id, COUNT(*) AS n FROM clusters GROUP BY 1) SELECT COUNT(*) AS n_clusters, COUNT(*) FILTER (WHERE n > 1) AS n_duplicate_clusters, CAST(SUM(n) AS BIGINT) AS n_items FROM s")
def cluster_summary(spark, sf_dir):
    return cl.summary(doc_clusters(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_id, path FROM dups")
def duplicate_clusters(spark, sf_dir):
    return cl.duplicates(doc_clusters(spark, sf_dir)).select("cluster_id", "path")


# -- plans -------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_PLAN} SELECT * FROM plan")
def dedup_plan(spark, sf_dir):
    return doc_plan(spark, sf_dir)


@query(f"WITH RECURSIVE {_PLAN} SELECT cluster_id, path, pixels, size, mtime, CAST(rank AS INTEGER) AS rank FROM ranked")
def cluster_ranks(spark, sf_dir):
    return pl.ranked(cl.duplicates(doc_clusters(spark, sf_dir)), doc_facts(spark, sf_dir)).select("cluster_id", "path", "pixels", "size", "mtime", "rank")


@query(f"WITH RECURSIVE {_PLAN} SELECT COUNT(DISTINCT cluster_id) AS n_clusters, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE action = 'KEEP') AS n_keep, COUNT(*) FILTER (WHERE action = 'DELETE') AS n_delete FROM plan")
def plan_stats(spark, sf_dir):
    return pl.stats(doc_plan(spark, sf_dir))


@query(f"WITH RECURSIVE {_PLAN} SELECT cluster_id, path, CASE WHEN k = 1 THEN 'keep' ELSE 'delete' END AS action, CASE WHEN k = 1 THEN 'Largest file kept' ELSE 'Smaller duplicate removed' END AS reason FROM (SELECT cluster_id, path, row_number() OVER (PARTITION BY cluster_id ORDER BY size DESC, path) AS k FROM plan)")
def auto_select(spark, sf_dir):
    return pl.auto_select(doc_files(spark, sf_dir))


@query(f"WITH RECURSIVE {_PLAN} SELECT cluster_id, path, row_number() OVER (PARTITION BY cluster_id ORDER BY size DESC, path) = 1 AND size > 0 AS is_largest, row_number() OVER (PARTITION BY cluster_id ORDER BY mtime, path) = 1 AS is_oldest FROM plan")
def badges(spark, sf_dir):
    return pl.badges(doc_files(spark, sf_dir))


@query(f"WITH RECURSIVE {_PLAN} SELECT cluster_id, path, 'delete' AS action, 'Set all to delete' AS reason FROM plan")
def set_all(spark, sf_dir):
    return pl.set_all(doc_plan(spark, sf_dir), "delete").select("cluster_id", "path", "action", "reason")


@query(f"WITH RECURSIVE {_PLAN} SELECT id, COUNT(*) AS n_files, MIN(path) AS first_path, CAST(SUM(size) AS BIGINT) AS size, CAST(MAX(modified) AS BIGINT) AS modified FROM (SELECT cluster_id AS id, path, CASE WHEN mtime % 2 = 0 THEN size ELSE 0 END AS size, CASE WHEN mtime % 2 = 0 THEN mtime ELSE 0 END AS modified FROM plan) GROUP BY 1")
def cluster_listing(spark, sf_dir):
    """The nested listing, summed up; files with an odd mtime count as missing."""
    known = doc_facts(spark, sf_dir).where("mtime % 2 = 0")
    rows = pl.listing(cl.duplicates(doc_clusters(spark, sf_dir)), known)
    total = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["size"])
    return rows.select("id", F.size("files").cast("long").alias("n_files"), F.get("files", F.lit(0))["path"].alias("first_path"), total.alias("size"), F.array_max(F.transform("files", lambda f: f["modified"])).alias("modified"))


@query(f"WITH RECURSIVE {_PLAN} SELECT d.cluster_id, d.path, k.path AS keeper FROM plan d LEFT JOIN plan k ON d.cluster_id = k.cluster_id AND k.action = 'KEEP' WHERE d.action = 'DELETE'")
def keeper_join(spark, sf_dir):
    return pl.with_keepers(doc_plan(spark, sf_dir)).select("cluster_id", "path", "keeper")


@query(f"WITH RECURSIVE {_PLAN} SELECT cluster_id, path, CASE WHEN mtime % 2 = 0 THEN lower(action) ELSE 'keep' END AS action FROM plan")
def review_join(spark, sf_dir):
    plan = doc_plan(spark, sf_dir)
    return pl.reviewed(plan.select("cluster_id", "path"), plan.where("mtime % 2 = 0"))


@query(f"WITH {_FACTS} SELECT path, name || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.x' AS name FROM (SELECT 'd/' || size || '/f' || (size % 50) || '.x/' || path AS path0, path, 'f' || (size % 50) AS name, row_number() OVER (PARTITION BY size % 50 ORDER BY 'd/' || path || '/f' || (size % 50) || '.x') - 1 AS k FROM facts)")
def quarantine_names(spark, sf_dir):
    """Names allotted to files of fifty base names, by path."""
    rows = doc_facts(spark, sf_dir).select(F.col("path").alias("own"), F.concat(F.lit("d/"), "path", F.lit("/f"), (F.col("size") % 50).cast("string"), F.lit(".x")).alias("path"))
    return quarantine.numbered(rows.select("path")).join(rows, "path").select(F.col("own").alias("path"), "name")


@query(f"WITH {_VEC_ITEMS} SELECT 'v,' || vec_id AS path, hash FROM items")
def index_round_trip(spark, sf_dir):
    """An index written as text, with commas in its paths, and read again."""
    path = scratch(spark, "index")
    interchange.write_index(vec_items(spark, sf_dir).select(F.concat(F.lit("v,"), F.col("vec_id").cast("string")).alias("path"), "hash"), path)
    return interchange.read_index(spark, path)


@query(f"WITH RECURSIVE {_PLAN} SELECT cluster_id AS \"clusterId\", lower(action) AS action, path, reason FROM plan")
def plan_round_trip(spark, sf_dir):
    """A plan written as quoted CSV and read again, actions normalised."""
    path = scratch(spark, "plan")
    interchange.write_plan(doc_plan(spark, sf_dir), path)
    return interchange.read_plan(spark, path)


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, CAST(path AS VARCHAR) AS path FROM dups")
def clusters_round_trip(spark, sf_dir):
    """Clusters written as text and read again."""
    path = scratch(spark, "clusters")
    interchange.write_clusters(cl.duplicates(doc_clusters(spark, sf_dir)), path)
    return interchange.read_clusters(spark, path)


@query(f"WITH RECURSIVE {_PLAN} SELECT CAST(cluster_id AS VARCHAR) AS \"clusterId\", action, CAST(path AS VARCHAR) AS path, reason FROM plan")
def plan_json_round_trip(spark, sf_dir):
    """A plan as one JSON list for each cluster, read again."""
    lists = doc_plan(spark, sf_dir).groupBy("cluster_id").agg(F.to_json(F.collect_list(F.struct(F.col("cluster_id").cast("string").alias("clusterId"), "action", F.col("path").cast("string").alias("path"), "reason"))).alias("body"))
    return lists.select(F.explode(interchange.plan_from_json(F.col("body"))).alias("r")).select("r.*")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS label FROM orders")
def day_labels(spark, sf_dir):
    millis = F.unix_millis(F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", scalars.day_label(millis).alias("label"))


@query("SELECT c_custkey, url_encode(c_name || ' & ' || c_mktsegment) AS part FROM customer")
def url_parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", scalars.url_component(F.concat_ws(" & ", "c_name", "c_mktsegment")).alias("part"))
