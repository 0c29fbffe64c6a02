"""Near copies of vectors by sorted passes over random projections.

A pass orders the vectors lexicographically by concatenated random hashes (the axis nearest to
the vector after a random rotation, one of 2 x PROJECTED, so a byte each), numbers them in that order and cuts the order
into blocks.  A vector is compared with the rest of its own block and with the next one, so its window holds between
WINDOW and 2 * WINDOW neighbours.  Where a block still links to the last one it was compared with, as in a large group
of near copies, its window is doubled until it no longer does: no link is given up because a group is crowded.
A vector carries its block in earlier passes, and how far that block reached, so a pair that was compared before is
not counted again and pairs never become rows: a vector leaves a pass as one row with its number of new links and one
link to its group in the block.  Components over these links unite the passes.

The number of passes grows with the table: ``ceil(log(N / WINDOW) / log(2 * PROJECTED))`` hashes tell a vector's place
apart from others, a pair at the threshold shares each with probability AT_THRESHOLD (measured for cosine 0.9 in 64
dimensions), and passes are added until a pair at the threshold is missed with probability MISSED at most.
Pairs above the threshold are found more often; a table within one window is compared whole.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
Vectors of different length do not link.  Every row counts, whatever its id: rows with equal vectors are linked, and
an id may come in several rows.  The component of a row is the smallest id in it (null if none has an id).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.llm.components import label_components
from tonemill.llm.workers import map_batches
from tonemill.operators.joins import lookup_join
from tonemill.session import durable

WINDOW = 1024
PROJECTED = 64
HASHES = 8
AT_THRESHOLD = 0.467
MISSED = 0.02
#: Cosines this close to the threshold are computed again by the plain formula.
DOUBT = 1e-9

FOUND = "block long, node string, links long, other string"


def passes_for(n: int, window: int = WINDOW) -> int:
    """How many passes leave at most MISSED of the pairs at the threshold unseen."""
    apart = max(0.0, math.log(max(n, 1) / window) / math.log(2 * PROJECTED))
    seen = AT_THRESHOLD**apart
    return 1 if seen >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log(1 - seen))


def _unpacked(cells: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest component first, so that no square leaves the range."""
    small = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return small / np.sqrt((small * small).sum(axis=1, keepdims=True))


def packed_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """((id, node, dims, vector), numpy type): vectors as bytes named by their digest; the last three are null if a vector takes no part."""
    element = table.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    cast = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), cast.alias("v")).select("id", F.when(finite, F.col("v")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            values, ends = v.values.to_numpy(zero_copy_only=False).astype(kind), v.offsets.to_numpy()
            here = v.is_valid().to_numpy(zero_copy_only=False)
            # Adding zero makes -0.0 equal to 0.0.
            cells = [(values[a:b] + 0).tobytes() if ok else None for ok, a, b in zip(here, ends[:-1], ends[1:], strict=True)]
            nodes = [None if c is None else hashlib.md5(c).hexdigest() for c in cells]
            dims = [None if c is None else len(c) // int(kind[2]) for c in cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.string()), pa.array(dims, pa.int32()), pa.array(cells, pa.binary())], names=["id", "node", "dims", "vector"])

    return map_batches(rows, run, "id long, node string, dims int, vector binary"), kind


def _with_keys(entries: DataFrame, number: int, kind: str) -> DataFrame:
    """Adds ``key``: the HASHES concatenated hashes of pass ``number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, np.ndarray] = {}
        for batch in batches:
            cells, dims = batch.column("vector").to_pylist(), batch.column("dims").to_numpy()
            keys: list[bytes | None] = [None] * len(cells)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in rotations:
                    rotations[d] = np.random.default_rng([11, number, d]).normal(size=(HASHES, d, PROJECTED))
                unit = _unit(_unpacked([cells[i] for i in at], kind))
                made = np.empty((len(at), HASHES), np.uint8)
                for h in range(HASHES):
                    turned = unit @ rotations[d][h]
                    axis = np.abs(turned).argmax(axis=1)
                    made[:, h] = 2 * axis + (turned[np.arange(len(at)), axis] > 0)
                for i, row in zip(at, made, strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])

    return map_batches(entries, run, T.StructType([*entries.schema.fields, T.StructField("key", T.BinaryType())]))


def _in_order(entries: DataFrame, number: int, kind: str, window: int) -> DataFrame:
    """The entries with the ``block`` that they have in the order of pass ``number``."""
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _with_keys(entries, number, kind).repartitionByRange(parts, "dims", "key", "node").sortWithinPartitions("dims", "key", "node")
    # The id of a row within its partition follows the sort.
    placed = ordered.select("*", F.monotonically_increasing_id().alias("place")).drop("key")
    stored = durable(placed.select("*", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("nth")).drop("place"), "vectors-in-order")
    sizes = {r["part"]: r["count"] for r in stored.groupBy("part").count().collect()}  # one row per partition
    starts, so_far = [], 0
    for part in sorted(sizes):
        starts.append((part, so_far))
        so_far += sizes[part]
    before = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    return stored.join(before, "part").withColumn("block", F.floor((F.col("before") + F.col("nth")) / window)).drop("part", "nth", "before")


def _new_links(left: pd.DataFrame, right: pd.DataFrame | None, kind: str, threshold: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """(i, j, reached): linked pairs not compared in an earlier pass, numbered over left then right.

    Without ``right`` pairs within ``left``, else pairs across; ``reached`` tells whether any pair is linked, new or not.
    """
    both = left if right is None else pd.concat([left, right], ignore_index=True)
    dims, i_all, j_all, reached = both["dims"].to_numpy(), [], [], False
    seen = [np.stack(both[c].map(np.asarray).to_list()) for c in ("blocks", "reaches")]
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        unit = _unit(_unpacked(both["vector"].iloc[at].to_list(), kind))
        a = at if right is None else at[at < len(left)]
        first, second = unit[: len(a)], unit if right is None else unit[len(a) :]
        cosine = first @ second.T
        close = np.triu(cosine >= threshold - DOUBT, 1) if right is None else cosine >= threshold - DOUBT
        i, j = np.nonzero(close)
        doubtful = np.flatnonzero(cosine[i, j] < threshold + DOUBT)
        if len(doubtful):
            x, y = (_unpacked(both["vector"].iloc[at].to_list(), kind)[k[doubtful]] for k in ((i, j) if right is None else (i, j + len(a))))
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
            plain = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            kept = np.ones(len(i), bool)
            kept[doubtful] = plain >= threshold
            i, j = i[kept], j[kept]
        i, j = at[i], (at if right is None else at[len(a) :])[j]
        reached = reached or len(i) > 0
        if seen[0].shape[1]:
            bi, bj = seen[0][i], seen[0][j]
            reach = np.where(bi <= bj, seen[1][i], seen[1][j])
            fresh = (np.abs(bi - bj) > reach).all(axis=1)
            i, j = i[fresh], j[fresh]
        i_all.append(i)
        j_all.append(j)
    return np.concatenate(i_all), np.concatenate(j_all), reached


def _grouped(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions is joined to by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        label = label[label]


def _compare(pairs: DataFrame, kind: str, threshold: float) -> DataFrame:
    """For each (block, step): one row per vector with new links, and a row without a node if the block reached step > 0."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        step = key[1].as_py()
        rows = group.to_pandas()
        rows = rows.sort_values(["later", "node"], ignore_index=True)
        left = rows[~rows["later"]]
        right = rows[rows["later"]].reset_index(drop=True)
        found = [_new_links(left, right, kind, threshold)] if len(left) and len(right) else []
        reached = bool(found) and found[0][2]
        if step == 1:
            found.append(_new_links(left, None, kind, threshold))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        copies, node = rows["n"].to_numpy(), rows["node"].to_numpy()
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        met = np.flatnonzero(links)
        group_of = _grouped(len(rows), i, j)
        blocks = [key[0].as_py()] * len(met) + [key[0].as_py()] * reached
        return pa.table({
            "block": pa.array(blocks, pa.int64()),
            "node": pa.array([*node[met], *[None] * reached], pa.string()),
            "links": pa.array([*links[met].astype(np.int64), *[0] * reached], pa.int64()),
            "other": pa.array([*node[group_of[met]], *[None] * reached], pa.string()),
        })

    return pairs.groupBy("at", "step").applyInArrow(run, FOUND)


def _pass(entries: DataFrame, number: int, kind: str, threshold: float, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """(entries with this pass among those they have seen, what was found)."""
    ordered = durable(_in_order(entries, number, kind, window), "vector-blocks")
    own = ordered.withColumns({"at": F.col("block"), "step": F.lit(1), "later": F.lit(False)})
    following = ordered.withColumns({"at": F.col("block") - 1, "step": F.lit(1), "later": F.lit(True)}).where("at >= 0")
    found = [durable(_compare(own.unionByName(following), kind, threshold), "vector-links")]
    # Blocks that linked to the last one they were compared with go on, twice as far each time.
    reach, reached = 1, found[0].where("node is null").select("block").distinct()
    far = [reached.select("block", F.lit(1).alias("reach"))]
    while reached.limit(1).count():
        steps = F.sequence(F.lit(reach + 1), F.lit(2 * reach + 1))
        wanted = reached.select(F.col("block").alias("at"), F.explode(steps).alias("step"))
        own = ordered.join(wanted.withColumn("block", F.col("at")), "block").withColumn("later", F.lit(False))
        other = ordered.join(wanted.withColumn("block", F.col("at") + F.col("step")), "block").withColumn("later", F.lit(True))
        found.append(durable(_compare(own.unionByName(other), kind, threshold), "vector-links"))
        reach = 2 * reach + 1
        far.append(reached.select("block", F.lit(reach).alias("reach")))
        reached = found[-1].where("node is null").select("block").distinct()
    reaches = far[0]
    for more in far[1:]:
        reaches = reaches.union(more)
    widest = reaches.groupBy("block").agg(F.max("reach").alias("reach"))
    known = lookup_join(ordered, widest, ["block"], "left", spread=["node"])
    seen = known.withColumns({
        "blocks": F.concat("blocks", F.array("block")), "reaches": F.concat("reaches", F.array(F.coalesce("reach", F.lit(1)).cast("long"))),
    })
    return seen.select(entries.columns), found


def link_near(
    table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", passes: int | None = None, window: int = WINDOW
) -> DataFrame:
    """(id, n_links, component_id, kept) per row: linked are pairs found with a cosine of ``threshold`` or more."""
    spark = table.sparkSession
    made, kind = packed_vectors(table, id_col, vector_col)
    rows = durable(made, "vectors")
    named = rows.where("node is not null")
    distinct = named.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    none = F.array().cast("array<long>")
    vectors = named.select("node", "dims", "vector").dropDuplicates(["node"])
    entries = durable(vectors.join(distinct, "node").select("node", "dims", "vector", "n", "first_id", none.alias("blocks"), none.alias("reaches")), "vector-entries")
    counts = entries.select("node", "n", "first_id")

    state, found = entries, []
    for number in range(passes if passes is not None else passes_for(entries.count(), window)):
        state, new = _pass(state, number, kind, threshold, window)
        found += new
    every = spark.createDataFrame([], FOUND)
    for part in found:
        every = every.union(part.where("node is not null"))
    links = durable(every.select("node", "links", "other"), "vector-links")
    labels = label_components(links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_node = links.groupBy("node").agg(F.sum("links").alias("links"))
    # Vectors that stand alone in one row need no answer of their own.
    of_interest = counts.join(per_node, "node", "left").where("n > 1 or links is not null").join(labels, "node", "left")
    known = durable(of_interest.withColumn("label", F.coalesce("label", "node")), "vector-answers")
    smallest = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    answers = lookup_join(known, smallest, ["label"], "left", spread=["node"])
    answers = answers.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("met"))
    joined = lookup_join(rows.select("id", "node"), answers, ["node"], "left", spread=["id"])
    component = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("id"))
    out = joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
