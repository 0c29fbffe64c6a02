"""Approximate nearest neighbours by balanced posting lists.

The largest inner product is turned into the smallest distance by one more coordinate (vectors
get ``sqrt(M^2 - |x|^2)`` with the largest norm ``M``, queries get 0), which keeps the order exactly.

Centroids are fitted on a bounded sample, split until no list of the sample is above its share.
Every vector is indexed: it goes to its nearest centroid and, as a boundary vector, to further
ones whose distance is within a ratio of the nearest, unless a nearer chosen centroid covers it.
Centroids are searched through an in-memory neighbour graph, best first, and a query visits the
lists whose centroid is within a ratio of the nearest one.  Posting lists are cut into pieces of
bounded size; a (list, piece) is matched with the queries that visit the list, block by block,
and gives at most ``k`` rows per query.  Scores are inner products of the original vectors in
double precision.

Equal vectors share one entry, which lists the smallest of their ids, as many as a result can
show; so a vector that is a third of all rows is one entry.  A query visits further lists until
the entries it has met guarantee ``k`` results, or all lists.

Defined results: vectors that are null, zero, or hold null or non-finite components, or whose
length differs from the others', take no part; neither do null ids.  Of rows that repeat an id
the best one counts for each query; a query id with several vectors is searched by each and
gets the best.  Ties go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonemill.llm.workers import map_batches
from tonemill.session import durable

#: Parameters: vectors that centroids are fitted on, and the most centroids (both bound what is broadcast).
SAMPLE, MOST_CENTROIDS = 40_000, 2_048
#: Sampled vectors per centroid, copies of a boundary vector, its distance ratio, and that of a query.
PER_LIST, COPIES, BOUNDARY_RATIO, QUERY_RATIO = 100, 6, 1.2, 1.15
#: Neighbours and random links per centroid in the graph; entries of a piece; queries that meet a piece at once.
DEGREE, LINKS, PIECE, BLOCK = 24, 8, 4_096, 512
#: The least share, and the least number, of lists that a query visits.
LEAST_SHARE, LEAST_LISTS = 0.1, 32


_FOUND = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))


@dataclass
class Centroids:
    """Centres in the lengthened space, their neighbour graph and the largest norm."""

    points: np.ndarray
    graph: np.ndarray
    largest: float

    def lengthened(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (vectors**2).sum(1), 0))
        return np.hstack([vectors, rest[:, None]])

    def search(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """About the ``width`` nearest centres by best-first steps in the graph, nearest first."""
        entries = np.arange(0, len(self.points), max(1, len(self.points) // 16))
        seen = set(entries.tolist())
        far = ((self.points[entries] - query) ** 2).sum(1)
        front = [(d, c) for d, c in zip(far.tolist(), entries.tolist(), strict=True)]
        heapq.heapify(front)
        best = [(-d, c) for d, c in front]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while front:
            d, c = heapq.heappop(front)
            if len(best) >= width and d > -best[0][0]:
                break
            near = [x for x in dict.fromkeys(self.graph[c].tolist()) if x not in seen]
            if not near:
                continue
            seen.update(near)
            for e, x in zip(((self.points[near] - query) ** 2).sum(1).tolist(), near, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(front, (e, x))
                    heapq.heappush(best, (-e, x))
                    if len(best) > width:
                        heapq.heappop(best)
        ordered = sorted((-d, c) for d, c in best)
        return np.array([c for _, c in ordered]), np.sqrt(np.array([d for d, _ in ordered]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)


def fit_centroids(sample: np.ndarray, largest: float, per_list: int = PER_LIST, seed: int = 7) -> Centroids:
    """Balanced centres: clusters above their share are split in two until none is."""
    points = Centroids(sample, sample, largest).lengthened(sample)
    rng = np.random.default_rng(seed)
    wanted = max(1, min(MOST_CENTROIDS, len(points) // per_list))
    centres = points[rng.choice(len(points), wanted, replace=False)]
    for _ in range(8):
        home = np.concatenate([_distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
        sizes = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        # Balance: empty and very small centres move next to the largest ones and split them.
        small, large = np.flatnonzero(sizes < per_list // 4), np.argsort(-sizes, kind="stable")
        for s, g in zip(small, large, strict=False):
            if sizes[g] > 2 * per_list:
                members = np.flatnonzero(home == g)
                centres[s] = points[rng.choice(members)]
    near = np.argsort(_distances(centres, centres), axis=1, kind="stable")[:, 1 : DEGREE + 1]
    # A few random links per centre lead from one group of centres to another.
    far = rng.integers(0, len(centres), (len(centres), LINKS))
    return Centroids(centres, np.hstack([near, far]), largest)


def _entries(rows: DataFrame, most: int) -> DataFrame:
    """(entry, vector, ids, norm): one row per distinct vector with its ``most`` smallest ids."""
    by_vector = W.partitionBy("vector").orderBy("id")
    ranked = rows.withColumn("nth", F.dense_rank().over(by_vector)).where(F.col("nth") <= most)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("first"), "vector", "ids")


def _usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): doubles, without the vectors that take no part."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0)).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assign(entries: DataFrame, centroids: Centroids, width: int) -> DataFrame:
    """(list, home, first, vector, ids): every entry in its nearest list and those it borders on."""
    shared = entries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Centroids = shared.value
        inner = np.sqrt(_distances(model.points, model.points))
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                far = np.sqrt(_distances(model.lengthened(_matrix(part.column(1), width)), model.points))
                order = np.argsort(far, axis=1, kind="stable")[:, : 4 * COPIES]
                row, lists, home = [], [], []
                for i, near in enumerate(order.tolist()):
                    chosen = [near[0]]
                    for c in near[1:]:
                        if len(chosen) == COPIES or far[i, c] > BOUNDARY_RATIO * far[i, near[0]]:
                            break
                        if all(inner[c, x] > far[i, c] * 0.5 for x in chosen):
                            chosen.append(c)
                    row += [i] * len(chosen)
                    lists += chosen
                    home += [True] + [False] * (len(chosen) - 1)
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(home, pa.bool_()), *taken.columns], names=["list", "home", "first", "vector", "ids"])

    return map_batches(entries, run, "list int, home boolean, first long, vector array<double>, ids array<long>")


def _visits(queries: DataFrame, centroids: Centroids, sizes: dict[int, int], k: int, width: int) -> DataFrame:
    """(list, query_id, vector): the lists each query visits."""
    shared = queries.sparkSession.sparkContext.broadcast((centroids, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, entries = shared.value
        total = len(model.points)
        for batch in batches:
            vectors = _matrix(batch.column(1), width)
            row, lists = [], []
            for i, vector in enumerate(vectors):
                reach = min(total, max(64, total // 2))
                query = np.append(vector * (model.largest / np.linalg.norm(vector)), 0.0)
                near, far = model.search(query, reach)
                least = max(LEAST_LISTS, int(total * LEAST_SHARE))
                chosen = [c for j, (c, d) in enumerate(zip(near.tolist(), far.tolist(), strict=True)) if j < least or d * d <= QUERY_RATIO * far[0] * far[0]]
                met = sum(entries.get(c, 0) for c in chosen)
                if met <= k:  # not yet sure of k results beside the query itself
                    rest = np.argsort(((model.points - query) ** 2).sum(1), kind="stable").tolist()
                    for c in rest:
                        if met > k:
                            break
                        if c not in chosen:
                            chosen.append(c)
                            met += entries.get(c, 0)
                row += [i] * len(chosen)
                lists += chosen
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *taken.columns], names=["list", "query_id", "vector"])

    return map_batches(queries, run, "list int, query_id long, vector array<double>")


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for every query the ``k`` nearest found among all other rows."""
    spark = table.sparkSession
    rows = _usable(table, id_col, vector_col)
    widths = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    out = "query_id long, rank int, id long, score double"
    if not widths:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    width = widths[0]["w"]
    rows = rows.where(F.size("vector") == width)
    entries = durable(_entries(rows, k + 1), "vector-entries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    stats = entries.agg(F.count("*").alias("n"), F.max(norm).alias("largest")).first()
    share = min(1.0, SAMPLE / stats["n"])
    draw = F.pmod(F.xxhash64("first"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = np.array([r[0] for r in entries.where(draw).select("vector").orderBy(F.xxhash64("first")).limit(SAMPLE).collect()])
    centroids = fit_centroids(sample, float(stats["largest"]))

    posted = durable(_assign(entries, centroids, width), "vector-lists")
    # One row per list, of which there are MOST_CENTROIDS at most: what is at home, and in how many pieces it is cut.
    at_home = F.sum(F.when(F.col("home"), F.size("ids")).otherwise(0)).alias("at_home")
    lists = durable(posted.groupBy("list").agg(at_home, F.ceil(F.count("*") / F.lit(PIECE)).cast("int").alias("pieces")), "vector-sizes")
    sizes = {r["list"]: r["at_home"] for r in lists.collect()}
    cut = F.broadcast(lists.select("list", "pieces"))

    asked = _usable(queries, id_col, vector_col).where(F.size("vector") == width).select(F.col("id").alias("query_id"), "vector").distinct()
    visits = _visits(asked, centroids, sizes, k, width)
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK)))).cast("int")
    visits = visits.withColumn("block", block).join(cut, "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    piece = F.pmod(F.xxhash64("first", F.lit(5)), F.col("pieces")).cast("int")
    found = _match(posted.join(cut, "list").withColumn("piece", piece), visits, k, width)
    return _merge(found, k, id_col)


def _match(posted: DataFrame, visits: DataFrame, k: int, width: int) -> DataFrame:
    """At most ``k`` rows per query, list piece and block: inner products of blocks of queries with pieces."""
    # Queries of a (list, block) are packed to one row of about BLOCK, entries of a piece to one of about PIECE.
    asked = visits.groupBy("list", "piece", "block").agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    entries = posted.groupBy("list", "piece").agg(F.collect_list(F.struct("vector", "ids")).alias("entries"))
    both = asked.join(entries, ["list", "piece"]).select("asked", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, left = batch.column(0).slice(i, 1).flatten().flatten()
                right, ids = batch.column(1).slice(i, 1).flatten().flatten()
                products = _matrix(left, width) @ _matrix(right, width).T
                lists = ids.to_pylist()
                best = [_top(q, line, lists, k) for q, line in zip(names.to_pylist(), products, strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(best, _FOUND)], names=["query_id", "found"])

    return map_batches(both, run, "query_id long, found array<struct<score:double,id:long>>")


def _merge(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best of what the lists of a query gave, an id once."""
    per_query = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    best_first = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(
        F.signum(a["id"] - b["id"]).cast("int")
    )
    # The best of an id comes first, so an id is kept where it occurs first.
    ordered = per_query.select("query_id", F.array_sort("found", best_first).alias("found"))
    ids = F.slice(F.array_distinct(F.transform("found", lambda x: x["id"])), 1, k)
    scored = F.transform(ids, lambda i: F.struct(i.alias("id"), F.element_at(F.transform(F.filter("found", lambda x: x["id"] == i), lambda x: x["score"]), 1).alias("score")))
    rows = ordered.select("query_id", F.posexplode(scored).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(id_col), "x.score")


def _top(query: int, line: np.ndarray, ids: list[list[int]], k: int) -> list[dict]:
    """The ``k`` best rows of one query among the entries, ties to the smaller id."""
    want = min(len(line), k + 1)
    bound = np.partition(line, len(line) - want)[len(line) - want]
    near = np.flatnonzero(line >= bound)
    rows = sorted((-float(line[j]), x) for j in near.tolist() for x in ids[j] if x != query)
    return [{"score": -s, "id": x} for s, x in rows[:k]]
