"""Nearest-neighbour classification and locally weighted naive Bayes.

Both compare queries with training rows.  No pair of rows is ever a row of a
DataFrame: rows meet in blocks of bounded size, each block is one numpy
computation, and what leaves it is at most ``k`` rows (neighbours) or one row of
sums per class (local models) for each query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemill.functions.text import unnest
from tonemill.operators.bayes import (
    average_votes,
    member_distributions,
    pack_classes,
    pack_members,
    pick_class,
)
from tonemill.operators.joins import lookup_join
from tonemill.session import durable

# The block functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 20_000
MAX_PIVOTS = 1024
QUERY_STEP = 128
# Pairs of a tile whose distances are summed up before the next.
TILE_QUERIES, TILE_ROWS = 64, 1024


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64)


def _column_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix, without a Python object per value."""
    flat = [np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks]
    return np.concatenate(flat).reshape(len(column), -1)


def _gaps(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows and points of one block."""
    squared = (rows**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2.0 * rows @ points.T
    return np.sqrt(np.maximum(squared, 0.0))


def _nearest_in_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, skip_self: bool
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ``k`` nearest rows of each query, by exact distance and then id.

    A matrix product proposes candidates with a margin far above its rounding
    error; only those are measured exactly.
    """
    norms = (rows**2).sum(1)
    for start in range(0, len(queries), QUERY_STEP):
        part = queries[start : start + QUERY_STEP]
        rough = (part**2).sum(1)[:, None] + norms[None, :] - 2.0 * part @ rows.T
        margin = 1e-9 * ((part**2).sum(1) + norms.max() + 1.0)
        for i in range(len(part)):
            q = start + i
            line = rough[i]
            if skip_self:
                line = np.where(ids == query_ids[q], np.inf, line)
            usable = int(np.isfinite(line).sum())
            take = min(k, usable)
            if take == 0:
                continue
            edge = np.partition(line, take - 1)[take - 1]
            near = np.flatnonzero(line <= edge + margin[i])
            exact = ((rows[near] - queries[q]) ** 2).sum(1)
            order = np.lexsort((ids[near], exact))[:take]
            yield q, near[order], exact[order]


def _distance_sums(asked: np.ndarray, points: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per asked row its largest distance to the points, and the sums over the points of the distance times each column.

    Pairs are worked through in tiles that stay in the cache of a core; every feature passes over a tile three times.
    """
    far, sums = np.zeros(len(asked)), np.zeros((len(asked), columns.shape[1]))
    by_feature = np.ascontiguousarray(points.T)
    for start in range(0, len(asked), TILE_QUERIES):
        part = asked[start : start + TILE_QUERIES]
        done = slice(start, start + len(part))
        for first in range(0, len(points), TILE_ROWS):
            rows = by_feature[:, first : first + TILE_ROWS]
            total, gap = np.zeros((len(part), rows.shape[1])), np.empty((len(part), rows.shape[1]))
            for i in range(len(rows)):
                np.subtract(part[:, i, None], rows[i], out=gap)
                np.multiply(gap, gap, out=gap)
                np.add(total, gap, out=total)
            np.sqrt(total, out=total)
            np.maximum(far[done], total.max(1), out=far[done])
            sums[done] += total @ columns[first : first + TILE_ROWS]
    return far, sums


def _pieces(sizes: dict[int, int], rows: int) -> Column:
    """A map from a group to the number of pieces that keep each of them near ``rows`` rows."""
    return F.create_map(*[F.lit(x) for group, n in sizes.items() for x in (group, max(1, -(-n // rows)))])


def _rows_per_piece(spark: SparkSession, asked: int, blocks: int, most: int) -> int:
    """Queries that go to one block: ``most``, or fewer where a few ``blocks`` of training rows would leave cores idle."""
    wanted = 4 * spark.sparkContext.defaultParallelism
    return min(most, max(QUERY_STEP, -(-asked * blocks // wanted)))


def _dealt(rows: DataFrame, place: list[str]) -> DataFrame:
    """Rows by their block; blocks are few and small on disk but costly, so their partitions are not to be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)


def _pivots(train: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """A fixed, bounded set of training points, chosen by the hash of their id."""
    rows = train.orderBy(F.xxhash64(key), key).select(vector).limit(n).collect()
    return np.array([r[vector] for r in rows], dtype=np.float64)


def _first_of_equal(rows: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """Of rows with equal vectors the ``n`` of the smallest ids; each task keeps as many before it shuffles.

    Equally near rows go by their id, so the other ones are never among the ``n`` nearest.
    """
    window = Window.partitionBy(vector).orderBy(key)
    return rows.withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") <= n).drop("_nth")


def nearest_rows(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    key: str = "id",
    vector: str = "vector",
    label: str = "label",
    skip_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, neighbour, label, dist2, rank): the exact ``k`` nearest training rows of every query.

    Training rows are cut into cells around pivots.  The cell sizes and radii give
    each query an upper bound for its k-th distance, and by the triangle
    inequality only cells that can lie within that bound are visited.  A cell that
    holds many rows is split over several blocks, and so are the queries, so a
    crowded cell becomes more blocks and not a larger one.  Rows with equal vectors
    count as often as they can be among the nearest.
    """
    spark = train.sparkSession
    wanted = k + 1 if skip_self else k
    train = durable(_first_of_equal(train.select(key, vector, label), key, vector, wanted))
    queries = durable(queries.select(key, vector))
    n_train = train.count()
    out = f"{key} long, neighbour long, label string, dist2 double"
    if n_train == 0 or queries.isEmpty():
        return spark.createDataFrame([], f"{out}, rank int")
    pivots = _pivots(train, key, vector, max(1, min(MAX_PIVOTS, n_train // max(1, block_rows // 4))))

    @F.pandas_udf("struct<cell:int,gap:double>")
    def home(values: pd.Series) -> pd.DataFrame:
        gaps = _gaps(_matrix(values), pivots)
        cell = gaps.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "gap": gaps[np.arange(len(gaps)), cell]})

    rows = train.select(
        F.col(key).alias("t_id"), F.col(vector).cast("array<double>").alias("t_vec"),
        F.col(label).cast("string").alias("t_label"),
    )
    placed = durable(rows.withColumn("_home", home("t_vec")).select("*", "_home.cell", "_home.gap").drop("_home"))
    cells = (
        placed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
        .orderBy("cell")
        .collect()
    )
    numbers = np.array([c["cell"] for c in cells])
    sizes = np.array([c["n"] for c in cells])
    low = np.array([c["low"] for c in cells])
    high = np.array([c["high"] for c in cells])

    @F.pandas_udf("struct<home:int,cells:array<int>>")
    def visits(values: pd.Series) -> pd.DataFrame:
        to_pivots = _gaps(_matrix(values), pivots)
        gaps = to_pivots[:, numbers]
        reach = gaps + high
        order = np.argsort(reach, axis=1)
        filled = np.cumsum(sizes[order], axis=1) >= wanted
        last = np.where(filled.any(1), filled.argmax(1), len(numbers) - 1)
        bound = reach[np.arange(len(gaps)), order[np.arange(len(gaps)), last]]
        bound = np.where(filled.any(1), bound, np.inf)
        nearest = np.maximum(np.maximum(gaps - high, low - gaps), 0.0)
        open_cells = nearest <= (bound * (1 + 1e-9) + 1e-9)[:, None]
        return pd.DataFrame(
            {
                "home": to_pivots.argmin(1).astype("int32"),
                "cells": [numbers[line].astype("int32").tolist() for line in open_cells],
            }
        )

    asked = queries.select(F.col(key).alias("q_id"), F.col(vector).cast("array<double>").alias("q_vec"))
    asked = durable(asked.withColumn("_v", visits("q_vec")).select("q_id", "q_vec", "_v.home", "_v.cells"))
    homes = {r["home"]: r["count"] for r in asked.groupBy("home").count().collect()}
    per_cell = _pieces({int(c["cell"]): c["n"] for c in cells}, block_rows)
    n_asked = sum(homes.values())
    per_home = _pieces(homes, _rows_per_piece(spark, n_asked, -(-n_train // block_rows), block_rows))
    # Queries of one home visit much the same cells, so a block of them meets few blocks of rows.
    piece = F.pmod(F.xxhash64("q_id"), per_home[F.col("home")])
    grouped = asked.withColumn("q_block", F.concat_ws("-", F.col("home"), piece))
    visiting = unnest(grouped, F.col("cells"), ["q_id", "q_vec", "q_block"], "cell")
    needed = visiting.select("cell", "q_block").distinct().groupBy("cell").agg(F.collect_list("q_block").alias("_q"))
    split = placed.withColumn("split", F.pmod(F.xxhash64("t_id"), per_cell[F.col("cell")]).cast("int"))
    block = unnest(
        lookup_join(split, needed, ["cell"], "inner", spread=["t_id"]), F.col("_q"),
        ["cell", "split", "t_id", "t_vec", "t_label"], "q_block",
    )
    asked_of = visiting.withColumn("split", F.explode(F.sequence(F.lit(0), per_cell[F.col("cell")] - 1)))
    found_schema = pa.schema(
        [(key, pa.int64()), ("neighbour", pa.int64()), ("label", pa.string()), ("dist2", pa.float64())]
    )

    def meet(points: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(points) or not len(asking):
            return found_schema.empty_table()
        ids, q_ids = np.asarray(points["t_id"]), np.asarray(asking["q_id"])
        asked_ids, near_rows, gaps = [], [], []
        for q, near, dist in _nearest_in_block(
            q_ids, _column_matrix(asking["q_vec"]), ids, _column_matrix(points["t_vec"]), k, skip_self
        ):
            asked_ids.append(np.full(len(near), q_ids[q]))
            near_rows.append(near)
            gaps.append(dist)
        if not asked_ids:
            return found_schema.empty_table()
        rows_found = np.concatenate(near_rows)
        labels_found = points["t_label"].combine_chunks().take(pa.array(rows_found))
        columns = [np.concatenate(asked_ids), ids[rows_found], labels_found, np.concatenate(gaps)]
        return pa.table(columns, schema=found_schema)

    place = ["cell", "split", "q_block"]
    close = _dealt(block, place).groupBy(*place).cogroup(_dealt(asked_of, place).groupBy(*place)).applyInArrow(meet, out)
    return top_neighbours(close, k, key)


def top_neighbours(pairs: DataFrame, k: int, key: str) -> DataFrame:
    """The first ``k`` candidates per query by distance and id."""
    window = Window.partitionBy(key).orderBy("dist2", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame, key: str = "id") -> DataFrame:
    """Majority class; equal counts go to the class with the nearest neighbour."""
    counted = neighbours.groupBy(key, "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first"))
    best = F.max_by(F.struct("label", "votes"), F.struct(F.col("votes"), -F.col("first")))
    return counted.groupBy(key).agg(best.alias("_b")).select(
        key, F.col("_b.label").alias("predicted"), F.col("_b.votes").alias("votes")
    )


def classify_nearest(
    queries: DataFrame, train: DataFrame, k: int = 1, key: str = "id", vector: str = "vector",
    label: str = "label", skip_self: bool = False,
) -> DataFrame:
    return vote(nearest_rows(queries, train, k, key, vector, label, skip_self), key)


Scale = tuple[np.ndarray, np.ndarray, np.ndarray]


def _scales(train: DataFrame, features: list[str]) -> dict[str, Scale]:
    """Per domain the lowest value, the width and the mean of every feature."""
    aggs = []
    for f in features:
        aggs += [F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"), F.avg(f).alias(f"mid_{f}")]
    found = {}
    for row in train.groupBy("_domain").agg(*aggs).collect():
        lo, hi, mid = (np.array([row[f"{kind}_{f}"] for f in features], dtype=np.float64) for kind in ("lo", "hi", "mid"))
        found[row["_domain"]] = lo, np.where(hi > lo, hi - lo, 1.0), mid
    return found


def _sizes(rows: DataFrame) -> dict[str, int]:
    return {r["_domain"]: r["count"] for r in rows.groupBy("_domain").count().collect()}


def classify_local(
    queries: DataFrame,
    train: DataFrame,
    features: list[str],
    key: str = "doc_id",
    label: str = "label",
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    by: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Locally weighted naive Bayes: a small model per query, fitted to distance-weighted rows.

    The weight of a training row is ``1.0001 - d / D`` with ``D`` the largest
    distance of the query, so it is linear in ``d``.  The weighted sums of a query
    therefore follow from plain sums of ``d``, ``d x`` and ``d x^2``, which add up
    over blocks, and one pass is enough although ``D`` is known only at the end.
    Equal rows are joined into one with a count, on both sides.

    With a column ``by`` queries meet the training rows of their own domain only.  It is part of every key, so
    any number of domains takes the same jobs; the ranges and sizes of the domains, one row each, reach the
    driver.  A query whose domain is null or has no training rows gets a null class.
    """
    spark = train.sparkSession
    domain = F.lit("") if by is None else F.col(by).cast("string")
    train = durable(train.select(domain.alias("_domain"), label, *features).filter("_domain is not null"))
    queries = durable(queries.select(key, *(keep or []), domain.alias("_domain"), *features))
    scales = _scales(train, features)
    if not scales:
        raise ValueError("no training rows")
    wide = len(features)
    distinct_train = train.groupBy("_domain", F.col(label).cast("string").alias("label"), *features).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    distinct_train = durable(distinct_train)
    known = queries.filter(F.col("_domain").isin(list(scales)))
    distinct_query = durable(known.select("_domain", *features).distinct().withColumn("q_vec", F.array(*features)))
    n_train, n_query = _sizes(distinct_train), _sizes(distinct_query)
    train_blocks = _pieces(n_train, block_rows)[F.col("_domain")]
    n_blocks = sum(-(-n // block_rows) for n in n_train.values())
    query_rows = _rows_per_piece(spark, sum(n_query.values()), n_blocks, block_rows)
    query_blocks = _pieces(n_query or {"": 0}, query_rows)[F.col("_domain")]
    place = ["_domain", "t_block", "q_block"]
    block = (
        distinct_train.withColumn("t_block", F.pmod(F.xxhash64("label", *features), train_blocks).cast("int"))
        .withColumn("vec", F.array(*features))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
        .select(*place, "label", "vec", "n")
    )
    asked = (
        distinct_query.withColumn("q_block", F.pmod(F.xxhash64(*features), query_blocks).cast("int"))
        .withColumn("t_block", F.explode(F.sequence(F.lit(0), train_blocks - 1)))
        .select(*place, "q_vec")
    )
    vector = pa.list_(pa.float64())
    sums_schema = pa.schema(
        [("_domain", pa.string()), ("q_vec", vector), ("label", pa.string()), ("far", pa.float64()), ("n", pa.float64()), ("d", pa.float64())]
        + [(c, vector) for c in ("x", "dx", "x2", "dx2")]
    )
    schema = (
        "_domain string, q_vec array<double>, label string, far double, n double, d double, "
        "x array<double>, dx array<double>, x2 array<double>, dx2 array<double>"
    )

    def lists(matrix: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(vector)

    def meet(group: tuple, points: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(points) or not len(asking):
            return sums_schema.empty_table()
        name_of = group[0].as_py()
        lo, width, mid = scales[name_of]
        raw, every = _column_matrix(asking["q_vec"]), _column_matrix(points["vec"])
        names, counts = np.array(points["label"].to_pylist(), dtype=object), np.asarray(points["n"])
        cut = []
        for name in sorted(set(names)):
            values, n = every[names == name], counts[names == name]
            x = values - mid
            nx, nx2 = n[:, None] * x, n[:, None] * x * x
            far, sums = _distance_sums((raw - lo) / width, (values - lo) / width, np.hstack([n[:, None], nx, nx2]))
            ones = np.ones((len(raw), 1))
            columns = [
                pa.array([name_of] * len(raw)), lists(raw), pa.array([name] * len(raw)), pa.array(far),
                pa.array(ones[:, 0] * n.sum()), pa.array(sums[:, 0]), lists(ones * nx.sum(0)), lists(sums[:, 1 : 1 + wide]),
                lists(ones * nx2.sum(0)), lists(sums[:, 1 + wide :]),
            ]
            cut.append(pa.table(columns, schema=sums_schema))
        return pa.concat_tables(cut).combine_chunks()

    parts = _dealt(block, place).groupBy(*place).cogroup(_dealt(asked, place).groupBy(*place)).applyInArrow(meet, schema)
    parts = parts.withColumn("q", F.struct("_domain", "q_vec"))
    sums = [F.max("far").alias("far"), F.sum("n").alias("n"), F.sum("d").alias("d")]
    for c in ("x", "dx", "x2", "dx2"):
        sums += [F.sum(F.col(c)[i]).alias(f"{c}{i}") for i in range(wide)]
    per_class = parts.groupBy("q", "label").agg(*sums)
    reach = F.max("far").over(Window.partitionBy("q"))
    # A query at distance 0 from every row weighs all of them alike.
    per_unit = F.when(F.col("_far") > 0, F.lit(1.0) / F.col("_far")).otherwise(0.0)

    def weighted(plain: str, by_distance: str):
        return F.lit(1.0001) * F.col(plain) - F.col("_u") * F.col(by_distance)

    total = per_class.withColumn("_far", reach).withColumn("_u", per_unit).withColumn("_w", weighted("n", "d"))
    middles = F.create_map(*[x for d, scale in scales.items() for x in (F.lit(d), F.array(*[F.lit(float(m)) for m in scale[2]]))])
    columns = []
    for i, f in enumerate(features):
        mean = weighted(f"x{i}", f"dx{i}") / F.col("_w")
        square = weighted(f"x2{i}", f"dx2{i}") / F.col("_w")
        columns += [
            (mean + middles[F.col("q._domain")][i]).alias(f"{f}_mean"),
            F.greatest(square - mean * mean, F.lit(0.0)).alias(f"{f}_var"),
        ]
    local = total.select("q", "label", F.col("_w").alias("n"), *columns)
    packed = pack_classes(local, features, ["q"], weights or {}).withColumn("member", F.lit("local"))
    members = pack_members(packed, "q", "member")
    rows = members.select("*", "q._domain", *[F.col("q.q_vec")[i].alias(f) for i, f in enumerate(features)])
    answers = pick_class(average_votes(member_distributions(rows, features))).drop("q")
    answered = lookup_join(queries, answers, ["_domain", *features], "left", spread=[key])
    return answered.select(key, *(keep or []), "dist", "predicted", "prob")
