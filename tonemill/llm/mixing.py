"""Mixing sources to target weights [native]: a Pfair schedule of source blocks.

Every source's documents are put in a fixed pseudo-random order (MD5 of the id) and cut into
blocks of about ``block_chars`` characters.  With integer target weights ``a`` and their sum
``D``, block ``k`` of a source is released at slot ``floor(k D / a)`` and due before slot
``ceil((k + 1) D / a)``; each slot takes the released block with the earliest deadline.  Since
unit blocks with such windows can always be scheduled, after any number of slots each source is
less than one block away from its share.

The schedule repeats every ``D`` slots and depends on the weights alone, so one period is worked
out from them once and all blocks find their slot by an equi-join with it.  The whole input is
kept: when a source has run out, its slots stay empty and the others go on in proportion.

Defined results: a null source is a source of its own; null or empty texts have length 0 and share
the block they fall in; a null id counts as an empty string for the order, and rows that repeat an
id are ordered by the hash of their text.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parameter: the sources, and the sum of their weights, that a schedule may have.
MAX_PERIOD = 100_000


def pfair_period(weights: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period of the schedule as rows (source key, weight, nth block of the period, release, slot)."""
    period = sum(weights.values())
    if period > MAX_PERIOD:
        raise ValueError(f"the weights add up to {period}; at most {MAX_PERIOD} slots make a period")
    names = sorted(weights)
    releases = sorted((k * period // weights[s], -(-(k + 1) * period // weights[s]), s, k) for s in names for k in range(weights[s]))
    ready: list[tuple[int, str, int, int]] = []
    rows, at = [], 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            release, deadline, source, k = releases[at]
            heapq.heappush(ready, (deadline, source, k, release))
            at += 1
        _, source, k, release = heapq.heappop(ready)
        rows.append((source, weights[source], k, release, slot))
    return rows


def source_key(source: str | None) -> str:
    """Sources as text; null gets a key that no text has."""
    return "null" if source is None else "=" + source


def relative_weights(docs: DataFrame, weights: Mapping[str | None, int], default: int = 1, source_col: str = "source") -> dict[str, int]:
    """The integer weight of every source that occurs, by source key."""
    names = [r[0] for r in docs.select(source_col).distinct().limit(MAX_PERIOD + 1).collect()]
    if len(names) > MAX_PERIOD:
        raise ValueError(f"more than {MAX_PERIOD} sources")
    return {source_key(n): int(weights.get(n, default)) for n in names}


def in_blocks(docs: DataFrame, block_chars: int, fan: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(id, source, n_chars, block, turn, kept columns): the block of every document in its source's order.

    A source may hold a third of all rows, so its order is cut into ``fan`` runs by the leading
    digits of the MD5; runs are summed first, and rows are only ordered inside a run.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_col),
        F.col(source_col).alias("source"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"),
        key.alias("turn"),
        F.when(F.col(source_col).isNull(), "null").otherwise(F.concat(F.lit("="), source_col)).alias("source_key"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_hash"),
        F.struct(*[F.col(c) for c in keep or [id_col]]).alias("row"),
    ).withColumn("run", F.pmod(F.conv(F.substring("turn", 1, 6), 16, 10).cast("long") * fan / F.lit(16**6), F.lit(fan)).cast("int"))
    runs = rows.groupBy("source_key", "run").agg(F.sum("n_chars").alias("run_chars"))
    earlier = W.partitionBy("source_key").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("source_key", "run", F.coalesce(F.sum("run_chars").over(earlier), F.lit(0)).alias("chars_before"))
    inside = W.partitionBy("source_key", "run").orderBy("turn", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_chars").over(inside), F.lit(0)))
    start = F.col("chars_before") + F.col("inside")
    block = F.floor(start / F.lit(block_chars)).cast("long")
    return rows.join(runs, ["source_key", "run"]).select(id_col, "source", "source_key", "n_chars", "turn", "text_hash", "row", start.alias("start"), block.alias("block"))


def mix(docs: DataFrame, weights: Mapping[str | None, int], block_chars: int = 65_536, default: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(id, source, n_chars, block, start, release, slot, turn, text_hash, row) for every document.

    The mixed order is ``slot, start, turn, text_hash``; ``row`` has the columns of ``keep``.  ``weights`` maps sources to positive integers; others get ``default``.
    """
    by_key = relative_weights(docs, weights, default, source_col)
    period = sum(by_key.values())
    rows = [dict(zip(("source_key", "weight", "nth", "first_release", "first_slot"), r, strict=True)) for r in pfair_period(by_key)]
    kind = "array<struct<source_key:string,weight:long,nth:long,first_release:long,first_slot:long>>"
    # A period has at most MAX_PERIOD narrow rows, which bounds what is broadcast.
    schedule = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    blocks = in_blocks(docs, block_chars, id_col=id_col, text_col=text_col, source_col=source_col, keep=keep)
    weight_of = schedule.groupBy("source_key").agg(F.max("weight").alias("weight"))
    blocks = blocks.join(F.broadcast(weight_of), "source_key")
    cycle = F.floor(F.col("block") / F.col("weight")).cast("long")
    blocks = blocks.withColumn("cycle", cycle).withColumn("nth", F.col("block") - F.col("cycle") * F.col("weight"))
    slotted = blocks.join(F.broadcast(schedule.drop("weight")), ["source_key", "nth"])
    at = F.col("cycle") * F.lit(period)
    return slotted.select(
        id_col, "source", "n_chars", "block", "start", (at + F.col("first_release")).alias("release"), (at + F.col("first_slot")).alias("slot"), "turn", "text_hash", "row"
    )


def in_mixed_order(docs: DataFrame, weights: Mapping[str | None, int], block_chars: int = 65_536, default: int = 1) -> DataFrame:
    """The same rows and columns, dealt to partitions and sorted so that they follow the schedule."""
    order = ["slot", "start", "turn", "text_hash"]
    mixed = mix(docs, weights, block_chars, default, keep=docs.columns).select(*order, "row")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row.*")
