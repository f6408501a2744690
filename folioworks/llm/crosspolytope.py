"""Approximate nearest neighbours with cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import scratch_dir, stored


@dataclass(frozen=True)
class Tables:
    """``tables`` hash tables, each a pseudo-rotation of three Hadamard rounds.

    How many buckets of a table a query looks into is fitted: the least number
    at which ``sample`` queries find ``recall`` of their true neighbours (they
    are compared with all rows).  Buckets of more than ``block_rows`` rows are
    split; a query visits all blocks of a bucket.
    """

    tables: int = 8
    neighbours: int = 10
    sample: int = 64
    recall: float = 0.96
    block_rows: int = 4096
    seed: int = 5


def signs(how: Tables, dims: int) -> np.ndarray:
    """The three diagonals of +-1 of every table."""
    count = np.arange(1, how.tables * 3 * dims + 1, dtype=np.uint64) + np.uint64(how.seed * 1_000_003)
    bits = W.mixed(count * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return (1 - 2 * bits.astype(np.int64)).reshape(how.tables, 3, dims).astype(np.float64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, dims = x.shape
    step = 1
    while step < dims:
        pairs = x.reshape(n, dims // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, dims)
        step *= 2
    return x / np.sqrt(dims)


def axes(vectors: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How near each vector lies to each signed axis of one table: n x 2 dims."""
    dims = diagonals.shape[1]
    unit = np.zeros((len(vectors), dims))
    # Halving the exponent first keeps squares of very large components finite.
    most = np.abs(vectors).max(axis=1, keepdims=True)
    unit[:, : vectors.shape[1]] = vectors / most
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for d in diagonals:
        unit = hadamard(unit * d)
    return np.concatenate([unit, -unit], axis=1)


def probed(near: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes, nearest first, ties to the lower number."""
    return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v as doubles; without nulls, zero vectors and non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    limit = F.lit(float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1)[:] if not column.offset else (
        column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def nearest(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its k nearest other points and their distances, ties to the smaller id."""
    for q, own in zip(queries, query_ids.tolist()):
        distance = np.sqrt(((points - q) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != own)
        if len(others) > k:
            bound = np.partition(distance[others], k - 1)[k - 1]
            others = others[distance[others] <= bound]
        best = others[np.lexsort((ids[others], distance[others]))][:k]
        yield own, ids[best], distance[best]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _fitted_probes(points: DataFrame, sample: list, dims: int, how: Tables) -> int:
    """The least number of probes at which the sample reaches the wanted recall."""
    ids = np.array([r.id for r in sample], dtype=np.int64)
    vectors = np.array([r.v for r in sample], dtype=np.float64)
    diagonals, k, n_axes = signs(how, dims), how.neighbours, 2 * dims
    place = np.stack([np.argsort(probed(axes(vectors, d), n_axes), axis=1) for d in diagonals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, points = batch.column(0).to_numpy(), _matrix(batch.column(1))
            home = np.stack([probed(axes(points, d), 1)[:, 0] for d in diagonals])
            at = {int(i): n for n, i in enumerate(own)}
            rows = []
            for q, (query_id, found, distance) in enumerate(nearest(vectors, ids, points, own, k)):
                for i, d in zip(found.tolist(), distance.tolist()):
                    rows.append((query_id, i, d, int(place[:, q, :][np.arange(how.tables), home[:, at[i]]].min()) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows]) for c in range(4)], ["query_id", "vec_id", "score", "probes"]
            ) if rows else pa.RecordBatch.from_pylist([], schema=_FOUND)

    found = points.mapInArrow(run, "query_id long, vec_id long, score double, probes long")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # Partitions send their best only; sample * neighbours rows come back.
    needed = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("probes").toPandas()
    if not len(needed):
        return n_axes
    return int(np.ceil(np.quantile(needed["probes"], how.recall)))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("probes", pa.int64())])


def search(vectors: DataFrame, is_query: Column, how: Tables = Tables(), id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, probes): the nearest rows found for each query
    by Euclidean distance on the original vectors, ties to the smaller id.

    Every usable row is indexed under its nearest signed axis in each table; a
    query row goes to its ``probes`` nearest axes.  Each block of a bucket
    ranks its rows for the queries that visit it and sends on
    ``how.neighbours`` a query, so candidate pairs never leave their task.
    A query that finds fewer looks into all buckets in a second turn.

    Null ids and vectors, zero vectors and those with null or non-finite
    components take no part; nor do vectors of another length than the most
    common one.  Repeated ids count as one row, with their nearest vector.
    """
    base = scratch_dir(vectors.sparkSession)
    points = _usable(vectors, id_col, vector_col)
    length = points.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, probes int")
    points = points.filter(F.size("v") == length.n)
    dims = 1 << max(0, int(length.n - 1).bit_length())
    asked = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    marked = stored(points.join(asked.withColumn("asked", F.lit(True)), "id", "left").select(
        "id", "v", F.coalesce("asked", F.lit(False)).alias("asked")), f"{base}/points")
    sample = marked.filter("asked").orderBy(F.xxhash64("id"), "id").limit(how.sample).select("id", "v").collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, probes int")
    probes = _fitted_probes(marked.select("id", "v"), sample, dims, how)
    diagonals = signs(how, dims)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(0))
            bucket = np.concatenate([t * 2 * dims + probed(axes(points, d), 1)[:, 0] for t, d in enumerate(diagonals)])
            bucket, n = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    # At most tables * 2 * dims rows.
    counts = marked.select("v").mapInArrow(homes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    blocks = {r.bucket: -(-r.n // how.block_rows) for r in counts}

    def dealt(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, points, asked = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            raw = [v.tobytes() for v in points]
            salt = W.mixed(ids.astype(np.uint64))
            rows = []
            for t, d in enumerate(diagonals):
                order = probed(axes(points, d), probes) + t * 2 * dims
                for i in range(len(ids)):
                    home = int(order[i, 0])
                    rows.append((home, int(salt[i] % np.uint64(blocks[home])), False, int(ids[i]), raw[i]))
                for i in np.flatnonzero(asked).tolist():
                    rows.extend((b, k, True, int(ids[i]), raw[i]) for b in order[i].tolist() for k in range(blocks.get(b, 0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows]) for c in range(5)], ["bucket", "block", "query", "id", "v"])

    def ranked(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        ids, points = table.column("id").to_numpy(), np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(len(query), -1)
        rows = [(q, i, s) for q, found, score in nearest(
            points[query], ids[query], points[~query], ids[~query], how.neighbours) for i, s in zip(found.tolist(), score.tolist())]
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    def visited(points: DataFrame, probes: int) -> DataFrame:
        spread = points.mapInArrow(
            lambda batches: dealt(batches, probes), "bucket long, block long, query boolean, id long, v binary")
        return spread.groupBy("bucket", "block").applyInArrow(ranked, "query_id long, vec_id long, score double")

    found = stored(visited(marked, probes), f"{base}/found")
    # Queries short of neighbours look into every bucket.
    served = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= how.neighbours)
    short = marked.filter("asked").join(served, F.col("id") == F.col("query_id"), "left_anti").select("id").distinct()
    short = stored(short.withColumn("short", F.lit(True)), f"{base}/short")
    if not short.isEmpty():
        rest = marked.drop("asked").join(short, "id", "left").select("id", "v", F.coalesce("short", F.lit(False)).alias("asked"))
        found = found.union(visited(rest, 2 * dims))
    return _top(found, how.neighbours).withColumn("probes", F.lit(probes))
