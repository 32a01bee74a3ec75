"""Nearest neighbours over randomly rotated one-bit codes.

Vectors are centred, normalised and rotated by a random orthogonal matrix; the index keeps the sign of
each rotated component as one packed bit, with two correction scalars: the norm, and the inner product
of the vector with its code. For a rotated query q the inner product with a vector is estimated as
<code, q> / <code, vector>, and the estimate's error is below EPSILON * sqrt((1 - f^2) / (f^2 (D - 1)))
with high probability, f being the second scalar. In each block of rows the vectors with the best
estimates are measured exactly first; every other vector whose bound could beat the worst of those is
then measured too. Scores are exact distances on the original vectors, in double precision.

Only the centre is fitted, on at most SAMPLE rows; every row is indexed. Queries meet all rows, as a
grid of row blocks and query blocks of bounded size, so no task holds more than one of each whatever
the input's size; blocks are by hash of vec_id, so copies of one vector spread evenly.

Defined results: vectors that are null, all zero, of another length than most, or hold null or
non-finite components take no part, as query or candidate; rows with the query's own vec_id are not its
candidates, and a vec_id that occurs more than once is one query; equal distances are ordered by
vec_id; a query with fewer candidates than asked for gets all of them; an empty table gives an empty
result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

EPSILON = 2.2
SAMPLE = 4096
SEED = 20240527
#: Rows and queries of one cell of the grid, at most (on average over hashed blocks).
ROW_BLOCK, QUERY_BLOCK = 65_536, 16_384


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each dimension on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms and code inner products of the rows of x."""
    y = (x - centre) @ turn
    norm = np.linalg.norm(y, axis=1)
    unit = y / np.where(norm > 0, norm, 1)[:, None]
    factor = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(unit > 0, axis=1), norm, np.where(norm > 0, factor, 1.0)


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float64 values of the vectors that take part."""
    length = np.asarray(pc.list_value_length(column).fill_null(-1))
    at = np.flatnonzero(length == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    flat = pc.list_flatten(column.take(pa.array(at)))
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[ok], x[ok]


def _indexer(dim: int, centre: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            at, x = _vectors(batch.column("v"), dim)
            code, norm, factor = encode(x, centre, turn)
            blob = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), blob(code), pa.array(norm, pa.float64()), pa.array(factor, pa.float64()), blob(x)], ["id", "code", "norm", "factor", "vec"])

    return index


def search_block(ids, codes, norm, factor, x, query_ids, queries, centre, turn, k: int, epsilon: float = EPSILON):
    """(query row, candidate row, distance) of each query's k nearest in the block."""
    dim = x.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    y = (queries - centre) @ turn
    q_norm = np.linalg.norm(y, axis=1)
    unit = (y / np.where(q_norm > 0, q_norm, 1)[:, None]).astype(np.float32)
    error = epsilon * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))
    out = []
    for lo in range(0, len(queries), 64):
        estimate = (unit[lo : lo + 64] @ signs.T) / (np.sqrt(dim) * factor)
        for i, row in enumerate(estimate, lo):
            square = norm**2 + q_norm[i] ** 2 - 2 * norm * q_norm[i] * row
            slack = 2 * norm * q_norm[i] * error
            square[ids == query_ids[i]] = np.inf
            first = np.argpartition(square, 4 * k)[: 4 * k] if len(square) > 4 * k else np.arange(len(square))
            exact = np.sqrt(((x[first] - queries[i]) ** 2).sum(axis=1))
            exact[ids[first] == query_ids[i]] = np.inf
            limit = np.partition(exact, k - 1)[k - 1] if len(exact) >= k else np.inf
            more = np.flatnonzero((square - slack <= limit**2) & np.isfinite(square))
            distance = np.sqrt(((x[more] - queries[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[more], distance))[:k]
            out.append((np.full(len(best), i), more[best], distance[best]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def _searcher(dim: int, centre: np.ndarray, k: int):
    def search(cell: pa.Table) -> pa.Table:
        is_query = cell.column("query").to_numpy()
        ids = cell.column("id").to_numpy()
        unpack = lambda name, kind: np.frombuffer(b"".join(cell.column(name).to_pylist()), kind).reshape(len(ids), -1)
        x, codes = unpack("vec", np.float64), unpack("code", np.uint8)
        norm, factor = cell.column("norm").to_numpy(), cell.column("factor").to_numpy()
        row, q = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        i, j, d = search_block(ids[row], codes[row], norm[row], factor[row], x[row], ids[q], x[q], centre, rotation(dim), k) if len(row) and len(q) else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        return pa.table({"query_id": ids[q][i].astype(np.int64), "vec_id": ids[row][j].astype(np.int64), "score": d})

    return search


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose vec_id is divisible by
    ``every``. The number of rows and the centre, one vector, are read before."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where("id is not null and v is not null")
    empty = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None or common["dim"] < 1:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, n = int(common["dim"]), int(common["count"])
    sample = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    _, x = _vectors(sample.select("v").toArrow().column("v").combine_chunks(), dim)
    centre = x.mean(axis=0) if len(x) else np.zeros(dim)
    index = cut(rows.mapInArrow(_indexer(dim, centre), "id long, code binary, norm double, factor double, vec binary"))
    n_rows = max(1, -(-n // min(ROW_BLOCK, max(4096, n // 16))))
    n_queries = max(1, -(-n // (every * QUERY_BLOCK)))
    h = F.xxhash64("id")
    cells = index.withColumns({"query": F.lit(False), "i": F.pmod(h, F.lit(n_rows)), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long")))})
    queries = index.where(F.col("id") % every == 0).dropDuplicates(["id"]).withColumns({"query": F.lit(True), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))), "j": F.pmod(h, F.lit(n_queries))})
    found = cells.unionByName(queries).groupBy("i", "j").applyInArrow(_searcher(dim, centre, k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
