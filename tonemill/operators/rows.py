"""Row filters, class numbering, chunking and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.feature import Bucketizer

from tonemill.functions.identity import domain_or_default
from tonemill.operators.joins import lookup_join


def usable_rows(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Training rows need a text and a class that is not empty."""
    return df.filter(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.col(label) != ""))


def with_domain(df: DataFrame, domain: str = "domain") -> DataFrame:
    return df.withColumn(domain, domain_or_default(F.col(domain)))


def text_and_label(df: DataFrame, text: str, label: str, keep: list[str] | None = None) -> DataFrame:
    """Any labelled table reduced to its text and its class, the class last."""
    return df.select(
        *(keep or []), F.col(text).alias("text"), F.col(label).cast("string").alias("label")
    )


def class_index(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by..., label, label_idx): classes numbered from 0 in name order.

    The distinct classes are few; the numbering runs on them and not on the rows.
    """
    by = by or []
    window = Window.partitionBy(*by).orderBy(label) if by else Window.orderBy(label)
    classes = df.filter(F.col(label).isNotNull()).select(*by, label).distinct()
    return classes.withColumn("label_idx", F.row_number().over(window) - 1)


def with_class_index(df: DataFrame, label: str = "label", spread: list[str] | None = None) -> DataFrame:
    return lookup_join(df, class_index(df, label), [label], "left", spread=spread)


def nominal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns read as names of values."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in columns else F.col(c) for c in df.columns])


def _runs(df: DataFrame, order: str, rows_per_part: int) -> list[float]:
    """Cut points that split the ids into runs of about ``rows_per_part`` rows."""
    parts = -(-df.count() // rows_per_part)
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    edges = df.agg(F.percentile_approx(F.col(order).cast("double"), shares, 10 * parts).alias("edges")).first()["edges"]
    return sorted(set(edges))


def numbered(
    df: DataFrame,
    by: list[str],
    order: str,
    newest_first: bool = False,
    rows_per_part: int = 1_000_000,
    name: str = "row_no",
) -> DataFrame:
    """Number the rows of each group from 1 in the order of a unique numeric id.

    A group may hold a large share of the table, so it is not sorted in one
    task.  The ids are cut into runs at fixed points; rows are numbered inside
    (group, run) and moved on by the count of the earlier runs.
    """
    edges = _runs(df, order, rows_per_part)
    if edges:
        splits = [float("-inf"), *edges, float("inf")]
        find = Bucketizer(splits=splits, inputCol="_id", outputCol="_run", handleInvalid="error")
        cut = find.transform(df.withColumn("_id", F.col(order).cast("double"))).drop("_id")
    else:
        cut = df.withColumn("_run", F.lit(0.0))
    direction = (lambda c: F.col(c).desc()) if newest_first else (lambda c: F.col(c).asc())
    earlier = (
        Window.partitionBy(*by).orderBy(direction("_run")).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*by, "_run").count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*by, "_run").orderBy(direction(order))
    placed = cut.withColumn("_n", F.row_number().over(inside))
    joined = lookup_join(placed, offsets, [*by, "_run"], "inner", spread=[order])
    return joined.withColumn(name, F.col("_n") + F.col("_offset")).drop("_n", "_offset", "_run")


def chunks(df: DataFrame, size: int, by: list[str], order: str) -> DataFrame:
    """Consecutive chunks of at most ``size`` rows per group, the last one the remainder."""
    if size <= 0:
        raise ValueError("the chunk size has to be positive")
    with_no = numbered(df, by, order)
    return with_no.withColumn("chunk", F.floor((F.col("row_no") - 1) / size)).drop("row_no")


def most_recent(df: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """The ``n`` rows of each group with the highest id; each task keeps ``n`` of a group before it shuffles."""
    newest = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def argmax_rows(df: DataFrame, key: list[str], score: Column, label: str, index: str) -> DataFrame:
    """The class of the highest score per key; equal scores go to the lowest class index.

    Written as an aggregate, so that each task sends one row per key.
    """
    best = F.max_by(F.struct(F.col(label), score.alias("score")), F.struct(score, -F.col(index)))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, F.col(f"_b.{label}").alias("predicted"), F.col("_b.score").alias("score"))
