"""Clusters around centroids: distances gathered from scalar lookup tables.

Vectors are turned into whole numbers, floor(scale * x), once.  In each round a task tabulates, for
each dimension, the squared difference between every value that occurs in its block of vectors and
every centroid; the distances of the block are then gathers from these tables, added up dimension
by dimension.  A task sends one row per cluster and dimension that its vectors were assigned to,
so what is shuffled and what reaches the driver depends on the number of centroids only.

Defined results: a vector takes part if it has exactly ``width`` components, none null or not
finite, and none beyond +-2^27 after scaling (squared distances then fit a long).  Every row counts,
rows with equal ids too; a null id is never a starting centroid unless too few rows have an id.  With fewer vectors
than ``k`` every vector is a starting centroid.  No vector, no row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.workers import map_batches
from tonemill.session import durable

LARGEST = 1 << 27
#: Vectors whose tables and distances are held at a time.
BLOCK = 2048


def whole_vectors(table: DataFrame, width: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, whole): the vectors that take part, as arrays of ``width`` whole numbers."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    usable = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double") * F.lit(float(scale))) < float(LARGEST)))
    rows = table.where((F.size(vector_col) == width) & usable)
    return rows.select(F.col(id_col).cast("long").alias("id"), scaled.cast("array<int>").alias("whole"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of the smallest sha256 of ``<seed>:<id>``; equal ids in the order of their components."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    ordered = vectors.select("whole", drawn.alias("drawn")).orderBy(F.asc_nulls_last("drawn"), "whole").limit(k)
    return np.array([r["whole"] for r in ordered.collect()], dtype=np.int64)


def nearest(whole: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every row; equal distances go to the smaller number."""
    total = np.zeros((len(whole), len(centroids)), np.int64)
    for d in range(whole.shape[1]):
        values, place = np.unique(whole[:, d], return_inverse=True)
        tabulated = (values[:, None] - centroids[None, :, d]) ** 2
        total += tabulated[place]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(whole)), cluster]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> (number of vectors, sum of each component), one bounded row per cluster in the driver."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, whole in _blocks(batches, width):
            cluster, _ = nearest(whole, shared.value)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += whole[cluster == c].sum(axis=0)
        met = np.flatnonzero(counts)
        cells = [np.repeat(met, width), np.tile(np.arange(width), len(met)), np.repeat(counts[met], width), sums[met].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["cluster", "dim", "n", "total"])

    parts = map_batches(vectors, run, "cluster long, dim long, n long, total long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    cells = parts.groupBy("cluster", "dim").agg(wide("n").alias("n"), wide("total").alias("total")).orderBy("cluster", "dim").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for cell in cells:
        out.setdefault(cell["cluster"], (int(cell["n"]), []))[1].append(int(cell["total"]))
    return out


def cluster(
    table: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids): every vector with its final centroid's number.

    The new centroid is the exact floor of each mean; one without vectors stays where it is.
    """
    vectors = durable(whole_vectors(table, width, scale, id_col, vector_col), "whole-vectors")
    centroids = first_centroids(vectors, k, seed).reshape(-1, width)
    if len(centroids):
        for _ in range(rounds):
            for number, (n, totals) in _sums(vectors, centroids).items():
                centroids[number] = [t // n for t in totals]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, whole in _blocks(batches, width):
            number, distance = nearest(whole, shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=[id_col, "cluster", "distance"])

    assigned = map_batches(vectors, run, f"`{id_col}` long, cluster int, distance long")
    return durable(assigned, "assigned-vectors"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; a sum that no long can hold is null."""
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")
    sums = {r["cluster"]: int(r["sum"]) for r in assigned.groupBy("cluster").agg(exact).collect()}  # one row per centroid
    fits = lambda x: x if x < 1 << 63 else None
    inertia = spark.createDataFrame([(c, fits(s), fits(sum(sums.values()))) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long")
    return assigned.join(F.broadcast(inertia.join(named, "cluster")), "cluster")
